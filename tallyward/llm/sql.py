"""SQL of the operators on whole rows: the manifest and the filter audit."""

from __future__ import annotations

UNBROKEN = "replace(text, chr(10), '')"
SOURCE_LEVELS, ROOT_LEVELS = 10, 7  # levels spelled out: 3 ** 10 rows a source, 3 ** 7 sources


def _manifest() -> str:
    part = lambda c: f"coalesce(cast(octet_length(encode(cast({c} AS varchar))) AS varchar) || ':' || cast({c} AS varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    ctes = [
        """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t)""",
        """marked AS (SELECT *, list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ord(c)::bigint)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1 AS even FROM documents, crc)""",
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN even THEN {leaf(UNBROKEN)} ELSE {leaf('text')} END AS seen FROM marked)",
        """f0 AS MATERIALIZED (SELECT doc_id, leaf, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n, seen AS cur, '' AS proof FROM leaves)""",
        "t0 AS MATERIALIZED (SELECT g, i, leaf AS h, n FROM f0)",
    ]

    def climb(k: int, end: int) -> None:
        mine = lambda p: f"CASE WHEN i % 3 = {p} THEN cur ELSE coalesce(a{p}, '') END"
        others = " || ".join(f"CASE WHEN i % 3 = {p} THEN '' ELSE coalesce(a{p}, '') END" for p in range(3))
        ctes.append(f"r{k} AS MATERIALIZED (SELECT g, i // 3 AS r, {', '.join(f'max(h) FILTER (i % 3 = {p}) AS a{p}' for p in range(3))} FROM t{k} GROUP BY 1, 2)")
        ctes.append(
            f"""t{end} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (n + 2) // 3 AS n
                  FROM t{k} GROUP BY g, i // 3, n)"""
        )
        ctes.append(
            f"""f{end} AS MATERIALIZED (SELECT doc_id, leaf, id, f.g, i // 3 AS i, (n + 2) // 3 AS n,
                  CASE WHEN n > 1 THEN sha256({' || '.join(map(mine, range(3)))}) ELSE cur END AS cur,
                  proof || CASE WHEN n > 1 THEN {others} ELSE '' END AS proof{', subroot' if k > SOURCE_LEVELS else ''}
                FROM f{k} f JOIN r{k} r ON f.g = r.g AND f.i // 3 = r.r)"""
        )

    for k in range(SOURCE_LEVELS):
        climb(k, k + 1)
    at = SOURCE_LEVELS
    ctes.append(f"t{at + 1} AS MATERIALIZED (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM t{at})")
    ctes.append(
        f"f{at + 1} AS MATERIALIZED (SELECT doc_id, leaf, id, 0 AS g, f.g AS i, s.n, cur, proof, s.h AS subroot FROM f{at} f JOIN t{at + 1} s ON s.i = f.g)"
    )
    for k in range(at + 1, at + 1 + ROOT_LEVELS):
        climb(k, k + 1)
    last = at + 1 + ROOT_LEVELS
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM f{last}, t{last}"""
    )


OP12_SQL = _manifest()

OP13_SQL = r"""
WITH letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, l, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS earlier
  FROM orders, range(1, 6) s(step), letters WHERE l = substr(filter_order, step::int, 1)
), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END | CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END |
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END |
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END |
    CASE WHEN x.doc_id > min(x.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts x LEFT JOIN known USING (doc_id)
), counts AS (SELECT part, good, toxic, mask, count(*) AS n FROM masks GROUP BY ALL),
found AS (
  SELECT part, filter_order, step, l,
    sum(n) FILTER (mask & (earlier | bit) = 0) AS kept, sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0 AND good) AS good_lost, sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0 AND toxic) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
  coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, l), 0)::bigint AS shapley
FROM found
"""

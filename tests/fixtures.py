"""Small hand-made logs; expected values in the tests are worked out on paper."""

DAY0 = 1_777_600_000 - 1_777_600_000 % 86400
EVENT_SCHEMA = (
    "event_id long, user_id long, ts long, ip string, asn long, asn_type string, country string, device_fp string, "
    "user_agent string, endpoint string, prompt_cluster string, prompt_text string, tokens_used long, success boolean"
)
ACCOUNT_SCHEMA = (
    "user_id long, label string, subtype string, ring_id string, username string, created_at long, "
    "signup_country string, payment_hash string, tz_offset double, takeover_ts long, evasion double, label_noisy string"
)


def event(event_id, user_id, ts, **over):
    base = dict(
        event_id=event_id, user_id=user_id, ts=DAY0 + ts, ip="1.1.1.1", asn=1, asn_type="residential", country="US",
        device_fp="fp_a", user_agent="ua", endpoint="/v1/chat", prompt_cluster="c", prompt_text="hi", tokens_used=10,
        success=True,
    )
    return tuple({**base, **over}.values())


def account(user_id, label="normal", **over):
    base = dict(
        user_id=user_id, label=label, subtype="regular", ring_id=None, username=f"n{user_id}", created_at=DAY0,
        signup_country="US", payment_hash=None, tz_offset=0.0, takeover_ts=None, evasion=0.0, label_noisy=label,
    )
    return tuple({**base, **over}.values())


def events(spark, *data):
    return spark.createDataFrame(list(data), EVENT_SCHEMA)


def accounts(spark, *data):
    return spark.createDataFrame(list(data), ACCOUNT_SCHEMA)

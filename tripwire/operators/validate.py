"""Argument checks of a notification request, as columns over a request DataFrame.

Errors reject the request; a half-specified webhook (template without URL or URL without
template) on a custom request only disables the webhook channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

VALID_TYPES = (0, 1, 2, 255)  # 0 normal, 1 alarm, 2 continue, 255 custom


def validate_request(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Add `errors` (array of codes, empty when valid) and `webhook_enabled`.

    `requests` needs alert_name, alert_type, audience, email_template, webhook, webhook_template.
    Names compare case-insensitively; the known-alert check is a left join on the name.
    """
    known = alerts.select(F.lower("alert_name").alias("_known")).distinct()
    r = requests.join(F.broadcast(known), F.lower(F.col("alert_name")) == F.col("_known"), "left")
    is_custom_name = F.lower(F.col("alert_name")) == "custom"
    custom = is_custom_name | (F.col("alert_type") == 255)
    email, hook_tpl = F.col("email_template"), F.col("webhook_template")
    checks = [
        (~F.col("alert_type").isin(*VALID_TYPES), "invalid_alert_type"),
        ((F.col("alert_type") == 255) & ~is_custom_name, "name_type_mismatch"),
        (~is_custom_name & F.col("_known").isNull(), "unknown_alert"),
        (custom & email.isNull() & hook_tpl.isNull(), "custom_needs_template"),
        (custom & email.isNotNull() & F.col("audience").isNull(), "custom_email_needs_audience"),
        (custom & F.col("audience").isNotNull() & email.isNull(), "custom_audience_needs_email_template"),
    ]
    errors = F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in checks]), lambda x: x.isNotNull())
    half_hook = custom & (hook_tpl.isNotNull() & F.col("webhook").isNull() | F.col("webhook").isNotNull() & hook_tpl.isNull())
    return r.withColumn("errors", errors).withColumn(
        "webhook_enabled", ~half_hook & hook_tpl.isNotNull() & F.col("webhook").isNotNull()).drop("_known")

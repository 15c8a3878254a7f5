"""Message rendering and the delivery gate, producing outbox rows (one per message and channel).

Sending mail or calling webhooks is a side effect outside Spark; the jobs stop at an outbox
table that a sender process (or a `foreachBatch` sink) drains.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tripwire.functions import text as tx
from tripwire.operators.routing import alert_meta, blackout_status

SUBJECT_PREFIX = "Alert -- "
OK_STATUS = "Status: 200 (OK)"


def instance_rows(instances: Column) -> Column:
    """Comma list of names -> one table row per name (only & stays escaped)."""
    return F.array_join(F.transform(F.split(instances, ","), lambda x: F.concat(
        F.lit("<tr><td>"), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("</td></tr>"))), "")


def _sub(body: Column, key: str, value: Column) -> Column:
    return F.replace(body, F.lit(key), value)


def render_email(template: Column, table_html: Column, instances: Column, alert_name: Column, wiki: Column) -> Column:
    """Fill TABLE (falls back to the instance list), WIKILINK, ALERTNAME, INSTANCES, in that order."""
    body = _sub(template, "##TABLE##", F.coalesce(table_html, instance_rows(instances)))
    link = F.concat(F.lit('Click <a href="'), wiki, F.lit('">here</a> for details and troubleshooting info'))
    body = _sub(body, "##WIKILINK##", F.coalesce(link, F.lit("")))
    body = _sub(body, "##ALERTNAME##", F.coalesce(alert_name, F.lit("")))
    return _sub(body, "##INSTANCES##", instance_rows(instances))


def pick_emoji(explicit: Column, alert_type: Column, normal: Column, alarm: Column, cont: Column,
               custom: Column | None = None) -> Column:
    """Explicit emoji wins; otherwise by alert type 0 normal / 1 alarm / 2 continue / 255 custom."""
    by_type = (F.when(alert_type == 0, normal).when(alert_type == 1, alarm).when(alert_type == 2, cont))
    if custom is not None:
        by_type = by_type.when(alert_type == 255, custom)
    return F.coalesce(explicit, by_type, F.lit(""))


def render_webhook(template: Column, wiki: Column, emoji: Column, username: Column, instances: Column,
                   alert_name: Column) -> Column:
    """Fill WIKILINK, EMOJI, USERNAME, INSTANCES, ALERTNAME, in that order."""
    link = F.concat(F.lit("Click <"), wiki, F.lit("|here> for details and troubleshooting info"))
    body = _sub(template, "##WIKILINK##", F.coalesce(link, F.lit("")))
    body = _sub(body, "##EMOJI##", emoji)
    user = F.concat(F.lit(',"username": "'), username, F.lit('"'))
    body = _sub(body, "##USERNAME##", F.coalesce(user, F.lit("")))
    body = _sub(body, "##INSTANCES##", F.coalesce(instances, F.lit("")))
    return _sub(body, "##ALERTNAME##", F.coalesce(alert_name, F.lit("")))


def outbox(messages: DataFrame, view: DataFrame, blackouts: DataFrame, as_of: dt.datetime,
           mail_profile: str | None = "Mail Profile", bypass_mute: bool = False,
           subject_prefix: str = SUBJECT_PREFIX) -> DataFrame:
    """Messages -> outbox rows, one per (message, channel) with the send decision and reason.

    `messages` needs alert_name, alert_type, audience, webhook, email_alert_template,
    webhook_alert_template, instances, table_html and optionally subject and custom_emoji (used by
    custom notifications, type 255). The caller's values win over the alert's metadata. A message of
    an alert that the view does not list is not sent (reason unknown_alert), unless it is a custom one. Muted alerts (unless bypassed) and alerts inside a
    blackout window at `as_of` are not sent.
    """
    meta = alert_meta(view).select(
        "alert_name", "alert_id", "send_to_webhook", "alert_wiki", "alarm_emoji", "normal_emoji",
        "continue_emoji", "is_muted", "emoji", "username",
        F.col("webhook_alert_template").alias("_m_webhook_tpl"), F.col("email_alert_template").alias("_m_email_tpl"),
        F.col("audience").alias("_m_audience"), F.col("webhook").alias("_m_webhook"))
    meta = blackout_status(meta.withColumn("_at", F.lit(as_of).cast("timestamp_ntz")), blackouts, "_at").drop("_at")
    m = messages if "subject" in messages.columns else messages.withColumn("subject", F.lit(None).cast("string"))
    j = m.join(F.broadcast(meta), "alert_name", "left")
    inst = F.coalesce(F.col("instances"), F.lit("not_specified"))
    wiki = tx.wiki_link(F.col("alert_wiki"), F.col("alert_name"))
    email_tpl = F.coalesce("email_alert_template", "_m_email_tpl")
    hook_tpl = F.coalesce("webhook_alert_template", "_m_webhook_tpl")
    audience = F.coalesce("audience", "_m_audience")
    hook_url = F.coalesce("webhook", "_m_webhook")
    muted = F.lit(False) if bypass_mute else F.coalesce(F.col("is_muted"), F.lit(False))
    blocked = F.coalesce(F.col("in_blackout"), F.lit(False))
    subject = F.concat(F.lit(subject_prefix), F.coalesce(F.col("subject"), F.concat(F.col("alert_name"), F.lit(" alert was raised"))))
    custom = F.col("custom_emoji") if "custom_emoji" in messages.columns else None
    emoji = pick_emoji(F.col("emoji"), F.col("alert_type"), F.col("normal_emoji"), F.col("alarm_emoji"),
                       F.col("continue_emoji"), custom)
    unknown = F.col("alert_id").isNull() & (F.col("alert_type") != 255)

    def reason(ready: Column, missing: "str | Column") -> Column:
        return (F.when(unknown, "unknown_alert").when(muted, "muted").when(blocked, "blackout")
                .when(~ready, missing).otherwise("sent"))

    email_ready = F.lit(mail_profile is not None) & email_tpl.isNotNull() & audience.isNotNull()
    email_missing = F.when(audience.isNull(), "no_audience").otherwise("no_email_channel")
    hook_ready = F.coalesce(F.col("send_to_webhook"), F.col("alert_type") == 255) & hook_tpl.isNotNull() & hook_url.isNotNull()
    email = F.struct(
        F.lit("email").alias("channel"), audience.alias("recipient"), subject.alias("subject"),
        render_email(email_tpl, F.col("table_html"), inst, F.col("alert_name"), wiki).alias("body"),
        reason(email_ready, email_missing).alias("reason"),
    )
    hook = F.struct(
        F.lit("webhook").alias("channel"), hook_url.alias("recipient"), F.lit(None).cast("string").alias("subject"),
        render_webhook(hook_tpl, wiki, emoji, F.col("username"), inst, F.col("alert_name")).alias("body"),
        reason(hook_ready, "webhook_disabled").alias("reason"),
    )
    x = j.select("alert_name", "alert_type", audience.alias("audience"), inst.alias("instances"),
                 F.explode(F.array(email, hook)).alias("_o"))
    return x.select(
        "alert_name", "alert_type", "_o.channel", "audience", "_o.recipient", "_o.subject", "_o.body",
        "instances", (F.col("_o.reason") == "sent").alias("send"), "_o.reason")


def failed_delivery_events(deliveries: DataFrame, source: str = "notify", keep: "list[str] | tuple" = ()) -> DataFrame:
    """ERROR events for webhook deliveries whose status is not OK (appended to the event log), after the columns `keep`."""
    bad = deliveries.filter(F.col("status") != OK_STATUS)
    return bad.select(
        *keep,
        F.col("delivered_at").alias("event_datetime"),
        F.lit(source).alias("event_source"),
        F.lit("ERROR").alias("event_type"),
        F.concat(F.lit("Error sending webhook notification for "), F.col("alert_name"), F.lit("; Message: "),
                 F.col("response"), F.lit("; Payload: "), F.col("body")).alias("event_text"),
    )

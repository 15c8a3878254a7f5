"""Tag targeting: which instances a job runs for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripwire.operators.thresholds import ci_equal


class TagNotFound(ValueError):
    """The job was given a (tag name, tag value) pair that no instance carries."""


def tag_filter(instance_tags: DataFrame, tag_name: str | None, tag_value: str | None) -> DataFrame | None:
    """Instance ids carrying the tag, or None for "all instances" (a half-given tag means all)."""
    if tag_name is None or tag_value is None:
        return None
    return instance_tags.filter(
        ci_equal(F.col("tag_name"), F.lit(tag_name)) & ci_equal(F.col("tag_value"), F.lit(tag_value))
    ).select("instance_id")


def matching_instances(instances: DataFrame, instance_tags: DataFrame, tag_name: str | None = None,
                       tag_value: str | None = None) -> DataFrame:
    """Instances matching the job's tag (semi-join; all instances when no tag is given)."""
    ids = tag_filter(instance_tags, tag_name, tag_value)
    if ids is None:
        return instances
    return instances.join(ids, "instance_id", "left_semi")


def check_tag(instance_tags: DataFrame, tag_name: str | None, tag_value: str | None) -> None:
    """Driver-side argument check: raise TagNotFound for an unknown tag (one-row probe)."""
    ids = tag_filter(instance_tags, tag_name, tag_value)
    if ids is not None and ids.isEmpty():
        raise TagNotFound(f"Tag not found: {tag_name}={tag_value}")

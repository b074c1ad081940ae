"""What every reader hands on to the build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE_COLUMNS = [
    "platform", "source_name", "channel_raw_id", "channel_name", "id", "person_raw_id", "person_name", "ts", "content",
    "reply_to_id", "attachment_count", "attachment_preview", "reaction_count", "reaction_summary",
    "reaction_details_json", "is_edited", "is_system", "ord",
]
CHANGE_SCHEMA = (
    "source_name string, platform string, entity_kind string, entity_raw_id string, previous_name string, "
    "new_name string, ts timestamp_ntz, kind string, payload_json string"
)
MEMBER_EVENT_SCHEMA = (
    "source_name string, platform string, channel_raw_id string, kind string, actor_raw_id string, "
    "target_raw_id string, ts timestamp_ntz, payload_json string"
)


@dataclass
class Export:
    """Normalised rows of one or more exports.

    ``ord`` is a struct (rank, path, pos): the reading order that decides which of
    several equal rows counts.
    """

    messages: DataFrame
    sources: DataFrame
    channels: DataFrame
    people: DataFrame
    name_changes: DataFrame
    member_events: DataFrame | None = None


def first_people(rows: DataFrame) -> DataFrame:
    """(platform, raw_id, display_name, ord): the first name each identity is seen under."""
    return rows.groupBy("platform", F.col("person_raw_id").alias("raw_id")).agg(
        F.min_by("person_name", "ord").alias("display_name"), F.min("ord").alias("ord")
    )


def merge(exports: list[Export]) -> Export:
    """Union of exports; of equal sources, channels and people the first one read counts."""

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    events = [e.member_events for e in exports if e.member_events is not None]
    people = union([e.people for e in exports]).groupBy("platform", "raw_id").agg(
        F.min_by("display_name", "ord").alias("display_name"), F.min("ord").alias("ord")
    )
    return Export(
        messages=union([e.messages.select(*MESSAGE_COLUMNS) for e in exports]),
        sources=union([e.sources for e in exports]).groupBy("name").agg(F.min("platform").alias("platform")),
        channels=union([e.channels for e in exports]).groupBy("source_name", "raw_id").agg(F.min("name").alias("name")),
        people=people,
        name_changes=union([e.name_changes for e in exports]),
        member_events=union(events) if events else None,
    )

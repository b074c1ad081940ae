"""Tables of a chat dataset and the filters every query takes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .session import written

#: message columns, in table order
MESSAGE_SCHEMA = (
    "id string, channel_id int, person_id int, ts timestamp_ntz, content string, reply_to_id string, "
    "word_count int, char_count int, attachment_count int, attachment_preview string, "
    "reaction_count int, reaction_summary string, reaction_details_json string, "
    "is_edited boolean, is_system boolean, lang string, sentiment float, conversation_id bigint"
)

#: partition column of stored messages, year * 100 + month
MONTH_KEY = "month_key"

METRICS = ("messages", "words", "conversations")


def int_list(text: str | None, name: str) -> tuple[int, ...]:
    """Comma separated whole numbers; anything else is an error."""
    items = []
    for part in (text or "").split(","):
        part = part.strip()
        if not part:
            continue
        try:
            items.append(int(part))
        except ValueError as exc:
            raise ValueError(f"Invalid {name} filter: {part!r}") from exc
    return tuple(items)


def text_list(text: str | None) -> tuple[str, ...]:
    return tuple(part.strip() for part in (text or "").split(",") if part.strip())


@dataclass(frozen=True)
class Filters:
    start: date | None = None
    end: date | None = None
    people: tuple[int, ...] = ()
    themes: tuple[int, ...] = ()
    platforms: tuple[str, ...] = ()
    include_bots: bool = False

    @classmethod
    def parse(
        cls,
        start: date | None = None,
        end: date | None = None,
        people: str | None = None,
        themes: str | None = None,
        platforms: str | None = None,
        include_bots: bool = False,
    ) -> "Filters":
        """Filters from comma separated text, as typed in a request."""
        return cls(
            start, end, int_list(people, "people"), int_list(themes, "themes"), text_list(platforms), include_bots
        )


def check_metric(metric: str) -> str:
    name = metric.strip().casefold()
    if name not in METRICS:
        raise ValueError(f"Invalid metric filter: {metric!r}")
    return name


@dataclass
class Chat:
    """A dataset: the fact table, its dimensions, and the tables derived from them.

    Derived tables that are None are computed from message content on the fly.
    ``places`` and ``ordered`` number messages in (channel, ts, id) order; the first
    is sorted by id, the second by number. ``months`` lists the months with messages.
    """

    messages: DataFrame
    channels: DataFrame
    sources: DataFrame
    people: DataFrame
    themes: DataFrame
    config: Config = field(default_factory=Config)
    tokens: DataFrame | None = None
    links: DataFrame | None = None
    mentions: DataFrame | None = None
    trigrams: DataFrame | None = None
    reaction_events: DataFrame | None = None
    person_stats: DataFrame | None = None
    conversations: DataFrame | None = None
    platform_identities: DataFrame | None = None
    person_name_changes: DataFrame | None = None
    channel_name_changes: DataFrame | None = None
    member_events: DataFrame | None = None
    places: DataFrame | None = None
    ordered: DataFrame | None = None
    months: DataFrame | None = None

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several operators read: written when first asked for, read after that."""
        kept = self.__dict__.setdefault("_once", {})
        if name not in kept:
            kept[name] = written(make())
        return kept[name]

    @property
    def spark(self) -> SparkSession:
        return self.messages.sparkSession

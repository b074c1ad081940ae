"""User configuration: people, themes, moderation. Strictly checked, then turned
into small DataFrames whose size is the size of the configuration files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .session import local_frame

IDENTITY_SCHEMA = "platform string, raw_id string, person string, hint string, is_bot boolean, pos int"
PERSON_SCHEMA = "person string, hint string, color string, avatar string, is_bot boolean, pos int"
THEME_CHANNEL_SCHEMA = "source string, channel string, theme string, theme_pos int, pos int"
THEME_SCHEMA = "id int, name string, emoji string"


@dataclass(frozen=True)
class Identity:
    platform: str
    raw_id: str


@dataclass(frozen=True)
class PersonRule:
    name: str
    color: str = ""
    avatar: str = ""
    is_bot: bool = False
    identities: tuple[Identity, ...] = ()

    @property
    def hint(self) -> str:
        """Colour hint; a configured person without a colour is still marked as known."""
        return self.color or self.name


@dataclass(frozen=True)
class ThemeRule:
    name: str
    emoji: str = ""
    channels: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Config:
    people: tuple[PersonRule, ...] = ()
    themes: tuple[ThemeRule, ...] = ()
    excluded_message_ids: frozenset[str] = frozenset()
    blocked_sha256: frozenset[str] = frozenset()
    blocked_filenames: frozenset[str] = frozenset()
    facebook_names: dict[str, str] = field(default_factory=dict)

    @property
    def bot_names(self) -> list[str]:
        return sorted({p.name for p in self.people if p.is_bot})

    @property
    def person_names(self) -> list[str]:
        return sorted({p.name for p in self.people})

    @property
    def primary_person(self) -> str | None:
        return self.people[0].name if self.people else None

    def theme_names(self, ids: tuple[int, ...]) -> list[str]:
        """Theme ids are 1-based positions in the configuration."""
        return [self.themes[i - 1].name for i in ids if 1 <= i <= len(self.themes)]

    # -- as DataFrames -----------------------------------------------------
    def identities_df(self, spark: SparkSession) -> DataFrame:
        rows = []
        for person in self.people:
            for ident in person.identities:
                rows.append((ident.platform, ident.raw_id, person.name, person.hint, person.is_bot, len(rows)))
        return local_frame(spark, rows, IDENTITY_SCHEMA)

    def people_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p.name, p.hint, p.color, p.avatar, p.is_bot, i) for i, p in enumerate(self.people)]
        return local_frame(spark, rows, PERSON_SCHEMA)

    def theme_channels_df(self, spark: SparkSession) -> DataFrame:
        rows = []
        for pos, theme in enumerate(self.themes, start=1):
            for source, channel in theme.channels:
                rows.append((source, channel, theme.name, pos, len(rows)))
        return local_frame(spark, rows, THEME_CHANNEL_SCHEMA)

    def themes_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.name, t.emoji) for i, t in enumerate(self.themes, start=1)]
        return local_frame(spark, rows, THEME_SCHEMA)


def _only(data: Any, allowed: set[str], where: str) -> dict:
    if not isinstance(data, dict):
        raise ValueError(f"{where}: expected a mapping")
    extra = set(data) - allowed
    if extra:
        raise ValueError(f"{where}: unknown keys {sorted(extra)}")
    return data


def _text(value: Any, where: str) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"{where}: non-empty text required")
    return value


def squash(value: str) -> str:
    """Case-folded text with single spaces, the key used to compare names."""
    return " ".join(value.strip().casefold().split())


def parse_people(data: Any) -> tuple[PersonRule, ...]:
    people: list[PersonRule] = []
    bot_flag: dict[str, bool] = {}
    owner: dict[tuple[str, str], tuple[str, str]] = {}
    for entry in _only(data or {}, {"people"}, "people file").get("people") or []:
        _only(entry, {"name", "color", "avatar", "is_bot", "identities"}, "person")
        name = _text(entry.get("name"), "person name")
        is_bot = entry.get("is_bot", False)
        if not isinstance(is_bot, bool):
            raise ValueError(f"is_bot must be true or false for {name!r}")
        if bot_flag.setdefault(squash(name), is_bot) != is_bot:
            raise ValueError(f"conflicting is_bot values for {name!r}")
        rule = PersonRule(name, entry.get("color") or "", entry.get("avatar") or "", is_bot)
        identities = []
        for ident in entry.get("identities") or []:
            _only(ident, {"platform", "id", "username", "name"}, f"identity of {name!r}")
            raw = ident.get("id") or ident.get("username") or ident.get("name")
            if raw is None or raw == "":
                raise ValueError(f"identity of {name!r}: one of id, username or name is required")
            key = (_text(ident.get("platform"), "platform").lower(), str(raw))
            if owner.setdefault(key, (rule.name, rule.hint)) != (rule.name, rule.hint):
                raise ValueError(f"identity {key[0]}:{key[1]} is assigned to two people")
            identities.append(Identity(*key))
        people.append(PersonRule(rule.name, rule.color, rule.avatar, is_bot, tuple(identities)))
    return tuple(people)


def parse_themes(data: Any) -> tuple[ThemeRule, ...]:
    themes: list[ThemeRule] = []
    owner: dict[tuple[str, str], str] = {}
    for entry in _only(data or {}, {"themes"}, "themes file").get("themes") or []:
        _only(entry, {"name", "emoji", "channels"}, "theme")
        name = _text(entry.get("name"), "theme name")
        channels = []
        for item in entry.get("channels") or []:
            _only(item, {"source", "channel"}, f"channel of {name!r}")
            key = (_text(item.get("source"), "source"), _text(item.get("channel"), "channel"))
            if owner.setdefault(key, name) != name:
                raise ValueError(f"channel {key[0]}:{key[1]} is assigned to two themes")
            channels.append(key)
        themes.append(ThemeRule(name, entry.get("emoji") or "", tuple(channels)))
    return tuple(themes)


def parse_moderation(data: Any) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    data = _only(data or {}, {"excluded_message_ids", "blocked_media"}, "moderation file")
    media = _only(data.get("blocked_media") or {}, {"sha256", "filenames"}, "blocked_media")
    hashes = {str(h).strip().lower() for h in media.get("sha256") or []}
    bad = [h for h in hashes if not re.fullmatch("[0-9a-f]{64}", h)]
    if bad:
        raise ValueError(f"invalid SHA-256 digest: {bad[0]!r}")
    names = {PurePosixPath(str(n)).name.casefold() for n in media.get("filenames") or []}
    ids = {str(i).strip() for i in data.get("excluded_message_ids") or []}
    return frozenset(ids - {""}), frozenset(hashes), frozenset(names - {""})


def load_config(folder: str | Path) -> Config:
    """Read people.yaml, themes.yaml, moderation.yaml and fb_chat_names.json."""
    import yaml

    folder = Path(folder)

    def read(name: str) -> Any:
        path = folder / name
        return yaml.safe_load(path.read_text(encoding="utf-8")) if path.exists() else None

    ids, hashes, names = parse_moderation(read("moderation.yaml"))
    if not (folder / "moderation.yaml").exists():
        legacy = read("excluded_messages.yaml")
        if isinstance(legacy, list):
            ids = frozenset(str(i).strip() for i in legacy if i and str(i).strip())
    fb = folder / "fb_chat_names.json"
    return Config(
        people=parse_people(read("people.yaml")),
        themes=parse_themes(read("themes.yaml")),
        excluded_message_ids=ids,
        blocked_sha256=hashes,
        blocked_filenames=names,
        facebook_names=json.loads(fb.read_text(encoding="utf-8")) if fb.exists() else {},
    )

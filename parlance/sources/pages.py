"""Preview fields of web pages: title, description, image, site name, icon."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame

from .html import Node, parse_html

# --- fixed values: meta names in order of preference ------------------------
TITLE = ("og:title", "twitter:title")
DESCRIPTION = ("og:description", "twitter:description", "description")
IMAGE = ("og:image", "og:image:url", "twitter:image", "twitter:image:src")
SITE = ("og:site_name", "application-name")
# ----------------------------------------------------------------------------

SCHEMA = "url string, title string, description string, image string, site_name string, favicon string"


def _meta(page: Node, names: tuple[str, ...]) -> str | None:
    metas = page.all("meta")
    for name in names:
        tag = next((m for m in metas if m.get("property") == name), None) or next(
            (m for m in metas if m.get("name") == name), None
        )
        value = (tag.get("content") or "").strip() if tag is not None else ""
        if value:
            return value
    return None


def _joined(base: str | None, address: str | None) -> str | None:
    """``address`` as seen from ``base``; null where either cannot be parsed."""
    if not address:
        return None
    try:
        return urljoin(base or "", address)
    except ValueError:
        return None


def _host(url: str | None) -> str | None:
    try:
        return urlparse(url or "").netloc
    except ValueError:
        return None


def page_fields(url: str | None, html: str | None) -> tuple:
    page = parse_html(html or "")
    title = _meta(page, TITLE)
    if not title:
        head = page.one("title")
        title = "".join(head.strings()).strip() or None if head is not None else None
    image = _meta(page, IMAGE)
    icon = next((n for n in page.all("link") if "icon" in (n.get("rel") or "").lower()), None)
    href = (icon.get("href") or "").strip() if icon is not None else ""
    return (
        url, title, _meta(page, DESCRIPTION), _joined(url, image), _meta(page, SITE) or _host(url), _joined(url, href),
    )


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        yield pd.DataFrame([page_fields(u, h) for u, h in zip(batch["url"], batch["html"])], columns=columns)


def page_previews(pages: DataFrame) -> DataFrame:
    """Preview fields for rows of (url, html); relative addresses are resolved against the url.

    Fields that need an address that cannot be parsed are null; the row stays.
    """
    return pages.select("url", "html").mapInPandas(_fields, SCHEMA)

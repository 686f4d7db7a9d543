"""Extractor plugins: a registry, its executor, and declarative extractors made from a sample."""

from __future__ import annotations

import ast
import importlib.util
import json
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import content_type, is_html, links, review_reason, summary_lines
from ..functions.pages import title as page_title, unescape
from ..functions.scalars import header

RESULT = "content_type string, summary_lines array<string>, links array<string>, claimed boolean, extractor string"


class Extractor(Protocol):
    priority: int

    def can_handle(self, body: str, headers: dict, status: int) -> bool: ...

    def extract(self, title: str, body: str, headers: dict) -> tuple[str, list[str], list[str]]: ...


def _ship(extractor) -> None:
    """Let a plugin's module travel to the executors by value, as they can't import it."""
    module = sys.modules.get(type(extractor).__module__)
    if module is not None and not module.__name__.startswith("waymark."):
        cloudpickle.register_pickle_by_value(module)


class Registry:
    """Extractors by priority, then name; the first that claims a page and doesn't fail has it."""

    def __init__(self, extractors: list | None = None):
        self.extractors = []
        for e in extractors or []:
            self.register(e)

    def register(self, extractor):
        self.extractors.append(extractor() if isinstance(extractor, type) else extractor)
        _ship(self.extractors[-1])
        return extractor

    def ordered(self) -> list:
        return sorted(self.extractors, key=lambda e: (e.priority, type(e).__name__))

    def discover(self, folder: str | Path) -> Registry:
        """Loads every module of a folder whose name doesn't begin with an underscore; each calls register(registry)."""
        for path in sorted(Path(folder).glob("[!_]*.py")):
            spec = importlib.util.spec_from_file_location(f"waymark_plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            sys.modules[spec.name] = module
            spec.loader.exec_module(module)
            module.register(self)
        return self

    def run(self, title: str, body: str, headers: dict, status: int) -> tuple[str, list[str], list[str], bool, str]:
        headers = {"-".join(p.capitalize() for p in k.split("-")): v for k, v in (headers or {}).items()}
        for e in self.ordered():
            try:
                if e.can_handle(body, headers, status):
                    return (*e.extract(title, body, headers), True, type(e).__name__)
            except Exception:  # noqa: BLE001  a plugin's fault passes the page on
                continue
        return "", [], [], False, ""


class RuleExtractor:
    """An extractor from a rule: marks that a body must have (its white space as single blanks), a type and a line. Data, not code, so it can be checked."""

    def __init__(self, name: str, kind: str, marks: list[str], priority: int = 50, line: str = ""):
        self.name, self.kind, self.marks, self.priority, self.line = name, kind, [m.lower() for m in marks], priority, line

    def can_handle(self, body: str, headers: dict, status: int) -> bool:
        low = " ".join(body.lower().split())
        return bool(self.marks) and all(m in low for m in self.marks)

    def extract(self, title: str, body: str, headers: dict):
        return self.kind, [x for x in (f"{self.kind.title()}: {title}" if title else self.kind.title(), self.line) if x], []

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "kind": self.kind, "marks": self.marks, "priority": self.priority, "line": self.line})

    @classmethod
    def from_json(cls, text: str) -> RuleExtractor:
        return cls(**json.loads(text))


def run_plugins(pages: DataFrame, registry: Registry) -> DataFrame:
    """Pages (title, body, headers, status) with the result of the registry, by one Arrow-batched function."""
    names = ["content_type", "summary_lines", "links", "claimed", "extractor"]

    @F.pandas_udf(RESULT)
    def result(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for title, body, headers, status in parts:
            yield pd.DataFrame([registry.run(t or "", b or "", dict(h or {}), int(s or 0)) for t, b, h, s in zip(title, body, headers, status, strict=True)], columns=names)

    found = pages.withColumn("_r", result("title", "body", "headers", F.coalesce("status", F.lit(0)))).select(*pages.columns, "_r.*")
    return _judged(found)


def _judged(found: DataFrame) -> DataFrame:
    reason = review_reason(F.col("claimed"), F.col("summary_lines"), F.col("body"))
    return found.withColumn("review_reason", reason).withColumn("needs_review", (reason != "").cast("int"))


def run_builtin(pages: DataFrame) -> DataFrame:
    """The same with the built-in page extractor alone, as column expressions."""
    body, head = F.col("body"), F.coalesce(F.nullif("title", F.lit("")), page_title(F.col("body")))
    claimed = is_html(body, header(F.col("headers"), "Content-Type"))
    x = pages.withColumn("claimed", claimed).withColumn("content_type", F.when(claimed, content_type(head, body)).otherwise(""))
    empty = F.array().cast("array<string>")
    x = x.withColumn("summary_lines", F.when(F.col("claimed"), summary_lines(head, body, F.col("content_type"))).otherwise(empty))
    return _judged(x.withColumn("links", F.when(F.col("claimed"), links(body)).otherwise(empty)).withColumn("extractor", F.when(F.col("claimed"), "builtin").otherwise("")))


# Marks of frameworks that an inspection names.
FRAMEWORKS = {
    "WordPress": ("/wp-content/", "/wp-includes/"),
    "Drupal": ("drupalSettings", "views-view"),
    "Joomla": ("/components/com_", "tmpl=component"),
    "phpBB": ("Powered by phpBB", "posting.php"),
    "SMF": ("Simple Machines Forum", "/Themes/"),
    "Discourse": ("preloaded-user", "ember-auto-id"),
    "phpMyAdmin": ("pma__", "server_variables"),
    "Nextcloud": ("/apps/activity/", "settings-jar"),
    "ownCloud": ("data-owner=", "oc-core"),
}


def frameworks(body: Column) -> Column:
    """Frameworks of a body with the marks that were found."""
    low = F.lower(body)
    marks = {n: F.array_compact(F.array(*[F.when(low.contains(m.lower()), F.lit(m)) for m in ms])) for n, ms in FRAMEWORKS.items()}
    return F.array_compact(F.array(*[F.when(F.size(m) > 0, F.struct(F.lit(n).alias("name"), m.alias("marks"))) for n, m in marks.items()]))


# Attributes of meta tags that an inspection names, in order, and what it calls them.
META = {"generator": "generator", "author": "author", "application-name": "app_name"}
META_VALUE, META_PART, META_MOST = 64, 0.15, 4096
#: A meta tag, quoted values whole; an attribute with its value, in double or single quotes or bare.
META_TAG = r"""(?i)<meta(?=[\s/>])((?:"[^"]*"|'[^']*'|[^'">])*)>"""
ATTRIBUTE = r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""


def metas(body: Column) -> Column:
    """The attributes of each meta tag of a body, in order: maps of lower-case names to values ('' without one), whatever their
    order, case and quotes; of repeated names the last counts."""

    def attributes(tag: Column) -> Column:
        names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.lower(n))
        values = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), lambda v: unescape(F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2")))
        pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))

    return F.transform(F.regexp_extract_all(body, F.lit(META_TAG), F.lit(1)), attributes)


def meta_tags(body: Column) -> Column:
    """(name, value) of the meta tags in the first part of a body (15 percent, 4096 characters at most) that have an attribute
    called generator, else author, else application-name; the latter two cut to 64 characters."""
    part = F.substring(body, 1, F.least(F.floor(F.length(body) * META_PART), F.lit(META_MOST)).cast("int"))

    def named(tag: Column) -> Column:
        found = F.lit(None)
        for i, (attribute, name) in reversed(list(enumerate(META.items()))):
            value = F.coalesce(tag[attribute], F.lit(""))
            found = F.when(value != "", F.struct(F.lit(name).alias("name"), (value if not i else F.substring(value, 1, META_VALUE)).alias("value"))).otherwise(found)
        return found

    return F.array_compact(F.transform(metas(part), named))


def page_form(body: Column) -> Column:
    """What kind of document a body is: a JSON answer, a feed, a tracker, or ''."""
    low = F.lower(body)
    return F.when(low.rlike(r"^[\[{]"), "json_api").when(low.contains("<rss") | low.contains("<feed"), "xml_feed").when(low.contains("announce") & low.contains("torrent"), "torrent_tracker").otherwise("")


def structure(body: Column) -> Column:
    """Structural traits from the tags of the first 4096 characters of a body over 512: tables, forms, links."""
    tags = F.transform(F.regexp_extract_all(F.substring(body, 1, 4096), F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), lambda t: F.lower(t))
    of = lambda name: F.size(F.filter(tags, lambda t: t == name))
    enough = (F.length(body) > 512) & (F.size(tags) >= 5)
    return F.array_compact(F.array(
        F.when(enough & (of("table") / F.size(tags) > 0.25), "table_heavy"), F.when(enough & (of("form") >= 2), "form_based"), F.when(enough & (of("a") > F.size(tags) * 0.3), "link_dense"),
    ))


def detected_type(body: Column, content_type_header: Column) -> Column:
    """The type that an inspection proposes: the first framework, else by header and form."""
    ct, form, low, found = F.lower(F.coalesce(content_type_header, F.lit(""))), page_form(body), F.lower(body), frameworks(body)
    named = F.lower(F.replace(F.try_element_at(found, F.lit(1))["name"], F.lit(" "), F.lit("_")))
    kind = F.when(ct.contains("json") | (form == "json_api"), "json_api").when((ct.contains("xml") & (ct.contains("rss") | ct.contains("atom"))) | (form == "xml_feed"), "feed_rss").when(low.contains("announce") & low.contains("tracker"), "torrent_tracker").when(ct.contains("text/plain"), "plain_text").when(ct.contains("application/octet-stream"), "binary").otherwise("unknown")
    return F.coalesce(named, kind)


def propose(name: str, kind: str, marks: list[str]) -> RuleExtractor:
    """A rule for pages like a sample. A proposal without marks would claim everything and is refused."""
    if not marks:
        raise ValueError("an extractor needs at least one mark")
    return RuleExtractor(name, kind, marks)


def valid_source(text: str) -> bool:
    """Whether a generated module parses; it is never executed here."""
    try:
        ast.parse(text)
    except SyntaxError:
        return False
    return True

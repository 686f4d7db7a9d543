"""Names of languages, and summaries with a translated line; the detector is in ngrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ngrams import detect

# Names of languages by code.
NAMES = {
    "de": "German", "fr": "French", "es": "Spanish", "ja": "Japanese",
    "zh": "Chinese", "ru": "Russian", "pt": "Portuguese", "it": "Italian",
    "ko": "Korean", "ar": "Arabic", "nl": "Dutch", "sv": "Swedish",
    "no": "Norwegian", "da": "Danish", "fi": "Finnish", "pl": "Polish",
    "cs": "Czech", "hu": "Hungarian", "ro": "Romanian", "tr": "Turkish",
    "el": "Greek", "he": "Hebrew", "th": "Thai", "vi": "Vietnamese",
    "id": "Indonesian", "ms": "Malay", "hi": "Hindi", "uk": "Ukrainian",
    "ky": "Kyrgyz", "la": "Latin", "rw": "Kinyarwanda", "km": "Khmer",
    "be": "Belarusian", "bg": "Bulgarian", "sw": "Swahili", "mt": "Maltese",
}


def name_of(lang: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[lang], F.lit(""))


def needs_translation(summary: Column) -> Column:
    return (F.length(F.trim(F.coalesce(summary, F.lit("")))) >= 10) & ~F.coalesce(summary, F.lit("")).contains("[original:")


def _translatable(line: Column) -> Column:
    return ~line.startswith("http") & (F.length(line) >= 10)


def content_lines(summary: Column) -> Column:
    return F.filter(F.transform(F.split(summary, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def translation_input(summary: Column) -> Column:
    """The lines that a translator gets."""
    return F.array_join(F.filter(content_lines(summary), _translatable), "\n")


def translated_summary(summary: Column, translated: Column, lang: Column) -> Column:
    """A summary whose first translatable line is translated, under a tag of its language; the other lines follow."""
    name = name_of(lang)
    tag = F.concat(F.lit("[detected_language: "), lang, F.when(name != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""), F.lit("]"))
    lines = content_lines(summary)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    first = F.try_element_at(F.filter(numbered, lambda s: _translatable(s["x"])), F.lit(1))
    rest = F.transform(F.filter(numbered, lambda s: s["i"] != first["i"]), lambda s: s["x"])
    done = F.concat(F.array(tag, F.concat(translated, F.lit(" [original: "), first["x"], F.lit("]"))), rest)
    return F.when(F.size(lines) == 0, summary).when(first.isNull(), F.array_join(F.concat(F.array(tag), lines), "\n")).otherwise(F.array_join(done, "\n"))


def clean_answer(text: Column) -> Column:
    """A translator's answer: its first line if it has more than three."""
    return F.when(F.size(F.split(F.trim(text), "\n")) > 3, F.trim(F.substring_index(F.trim(text), "\n", 1))).otherwise(F.trim(text))


def analysis_json(answer: Column) -> Column:
    """An analysis as JSON: the answer if it is JSON, else wrapped."""
    ok = F.try_parse_json(answer).isNotNull()
    return F.when(ok, answer).otherwise(F.to_json(F.struct(answer.alias("raw_analysis"))))


__all__ = ["NAMES", "analysis_json", "clean_answer", "content_lines", "detect", "name_of", "needs_translation", "translated_summary", "translation_input"]

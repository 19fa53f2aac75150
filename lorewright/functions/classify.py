"""Rule-based classification as Column expressions (CLS-*)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Words of instructions.
HOW_TO = ["anleitung", "howto", "how to", "how-to", "tutorial", "schritt fuer schritt", "schritt für schritt", "step by step", "installation", "einrichten", "setup", "vorgehen", "ablauf", "checkliste", "checklist", "rezept", "recipe", "playbook", "runbook", "leitfaden", "guide"]
#: Words of events.
EVENTS = ["besprechung", "meeting", "protokoll", "termin", "gespraech", "gespräch", "sitzung", "call", "interview", "notiz vom", "tagebuch", "journal", "retrospektive", "retro", "standup", "stand-up", "workshop", "konferenz"]
#: Endings of reference material.
REFERENCE_ENDINGS = [".pdf", ".csv", ".tsv", ".json", ".xml", ".html", ".htm", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".log", ".rtf", ".tex"]
#: Endings of program text.
CODE = ["ts", "tsx", "js", "jsx", "py", "sql", "sh", "css", "rs", "go", "java"]
#: Endings of data.
DATA = ["json", "csv", "ini", "toml", "yaml", "yml", "env", "lock"]
#: Endings of documents.
DOCUMENTS = ["md", "txt", "pdf", "docx", "xlsx", "html", "eml", "log", "rtf"]
#: Dates in titles.
DATE = r"(?<![A-Za-z0-9_])(\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{1,2}/\d{1,2}/\d{2,4})(?![A-Za-z0-9_])"
#: The words of each topic; edges are those of ASCII words.
TOPICS = {
    "people": r"herr|frau|mr\.|mrs\.|kolleg|kunde|kundin|geburtstag|telefon|\+4[19]|e-mail:|mail:|kontakt|millers?",
    "projects": "projekt|mandant|kanzlei|auftrag|angelshop|freqtrade|shop",
    "events": r"20\d\d-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{2,4}|meeting|termin|getroffen|passierte|geschah|gestern|letzte woche",
    "tasks": "todo|to-do|offene punkte|muss noch|erledigen|fällig|frist|deadline|action item|zu tun|nächste schritte|next steps",
    "guides": r"anleitung|how[- ]?to|vorgehen|rezept|workflow|checkliste|so geht|setup|installation|schritt \d|step \d",
    "links": r"https?://|www\.|arxiv|github|quelle:|link zur",
}
#: Each match of a topic's pattern has one of these, in lower case (or, for events, a date's digits).
TOPIC_PARTS = {
    "people": ["herr", "frau", "mr.", "mrs.", "kolleg", "kund", "geburtstag", "telefon", "+4", "mail:", "kontakt", "miller"],
    "projects": ["shop", "projekt", "mandant", "kanzlei", "auftrag", "freqtrade"],
    "events": ["meeting", "termin", "getroffen", "passierte", "geschah", "gestern", "letzte woche"],
    "tasks": ["todo", "to-do", "offene punkte", "muss noch", "erledigen", "fällig", "frist", "deadline", "action item", "zu tun", "nächste schritte", "next steps"],
    "guides": ["anleitung", "howto", "how-to", "how to", "vorgehen", "rezept", "workflow", "checkliste", "so geht", "setup", "installation", "schritt ", "step "],
    "links": ["http", "www.", "arxiv", "github", "quelle:", "link zur"],
}
#: Letters beside those of ASCII that stand for s, i or k without regard to case.
FOLDED = ["ſ", "ı", "İ", "\u212a"]
#: The edge of an ASCII word, on either side.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
STEP = r"(?i)^\s*(\d{1,2}[.)]|schritt\s+\d|step\s+\d)\s+\S"
BULLET = r"^\s*[-*•]\s+\S"
TAG = r"<[^>\n]{1,200}>"


def numbered_steps(content: Column) -> Column:
    """CLS-02."""
    return F.size(F.filter(F.split(content, r"\r?\n"), lambda x: x.rlike(STEP)))


def bullets(content: Column) -> Column:
    """CLS-02."""
    return F.size(F.filter(F.split(content, r"\r?\n"), lambda x: x.rlike(BULLET)))


def markup_share(content: Column) -> Column:
    """CLS-02: share of the characters that stand in tags; 0 for an empty text."""
    return F.when(F.length(content) > 0, (F.length(content) - F.length(F.regexp_replace(content, TAG, ""))) / F.length(content)).otherwise(0.0)


def _first_of(text: Column, words: list[str]) -> Column:
    return F.coalesce(*[F.when(text.contains(w), w) for w in words])


def note_type(title: Column, content: Column, tags: Column, source: Column) -> Column:
    """CLS-01: struct (type, reason), from the strongest evidence to the weakest."""
    content = F.coalesce(content, F.lit(""))
    title_low, low = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(content, 1, 400))
    tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    steps = numbered_steps(content)
    how = F.coalesce(_first_of(title_low, HOW_TO), _first_of(F.substring(low, 1, 400), HOW_TO))
    event = _first_of(title_low, EVENTS)
    ending = F.coalesce(*[F.when(F.lower(source).endswith(e), e) for e in REFERENCE_ENDINGS])

    def said(kind: str, why) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))

    return (
        F.when(steps >= 3, said("procedural", F.concat(steps.cast("string"), F.lit(" numbered steps"))))
        .when(how.isNotNull() & ((steps >= 1) | (bullets(content) >= 3) | title_low.contains(how)), said("procedural", F.concat(F.lit("says "), how)))
        .when(event.isNotNull(), said("episodic", F.concat(event, F.lit(" in the title"))))
        .when(title.rlike(DATE), said("episodic", "date in the title"))
        .when(F.exists(tags, lambda t: t.isin(EVENTS)), said("episodic", "tag of an event"))
        .when(markup_share(content) > 0.25, said("reference", "mostly markup"))
        .when(ending.isNotNull(), said("reference", F.concat(F.lit("taken from "), ending)))
        .when(F.array_contains(tags, "machine-scan"), said("reference", "machine scan"))
        .otherwise(said("semantic", "plain text"))
    )


def source_path(content: Column, source: Column) -> Column:
    """CLS-12: the given path, else the one of the text's Source line, else empty."""
    given = F.trim(F.coalesce(source, F.lit("")))
    return F.when(given != "", given).otherwise(F.trim(F.regexp_extract(F.coalesce(content, F.lit("")), r"Source:\s*([^\n]+)", 1)))


def absolute_path(content: Column, source: Column) -> Column:
    """CLS-12: null where the path is not absolute."""
    path = source_path(content, source)
    return F.when(path.startswith("/"), path)


def looks_like_code(content: Column) -> Column:
    """CLS-09."""
    return content.rlike(r"""(?s)^\s*(export |import |function |const |let |interface |type |\w+\s*\([^)]*\)\s*\{|//|#include|SELECT |UPDATE |INSERT |\{.*":)""") | F.trim(content).rlike(r"""(?s)^\s*[\{\[].*["'].*["'][,\}\]]""")


def carrier(content: Column, tags: Column, source: Column) -> Column:
    """CLS-03: notes, files, code, data or other: by path ending, ending tag, then looks."""
    low = F.transform(tags, F.lower)
    ending = F.lower(F.regexp_extract(source_path(content, source), r"\.([A-Za-z0-9]+)$", 1))
    marks = F.filter(low, lambda t: t.isin(DATA + CODE + DOCUMENTS))
    mark = F.when(F.size(marks) > 0, F.element_at(marks, 1))

    def kind(e: Column) -> Column:
        return F.when(e.isin(DATA), "data").when(e.isin(CODE), "code").when(e.isin(DOCUMENTS), "files").otherwise("other")

    return F.when(~F.array_contains(low, "machine-scan"), "notes").when(ending != "", kind(ending)).when(mark.isNotNull(), kind(mark)).when(looks_like_code(content), "code").otherwise("other")


def topics(title: Column, content: Column, carried_by: Column) -> Column:
    """CLS-04: all topics a text has; code has none."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    text = F.when(carried_by == "code", F.lit(None).cast("string")).otherwise(text)
    low = F.lower(text)
    # letters that are those of the patterns without regard to case, though their lower case is not
    other = _says(text, FOLDED)
    found = []
    for name, words in TOPICS.items():
        may = other | _says(low, TOPIC_PARTS[name])
        if name == "events":
            may = may | text.rlike("[0-9][-.][0-9]")
        found.append(F.when(may & text.rlike(f"(?iu){EDGE}({words}){EDGE}"), name).otherwise(""))
    return F.array_remove(F.array(*found), "")


def _says(text: Column, parts: list[str]) -> Column:
    return functools.reduce(operator.or_, [text.contains(p) for p in parts])


def topic_bucket(found: Column) -> Column:
    """CLS-11: a note without a topic is in a bucket of its own."""
    return F.when(F.size(found) == 0, F.array(F.lit("no topic"))).otherwise(found)


def unusable(content: Column) -> Column:
    """CLS-05: the reason a text carries no knowledge, or null."""
    def judged(raw: Column, words: Column, lines: Column) -> Column:
        forms = F.array_sort(F.transform(lines, lambda x: F.substring(F.regexp_replace(F.regexp_replace(x, r"\d+", "#"), r"\s+", " "), 1, 60)))
        most = _longest_run(forms)
        distinct = F.size(F.array_distinct(F.transform(words, F.lower)))
        return (
            F.when(F.length(raw) < 20, "nearly empty")
            .when(markup_share(raw) > 0.4, "mostly markup")
            .when((F.length(raw) > 300) & (F.size(words) < 20), "many characters, few words")
            .when((F.size(lines) >= 8) & (most / F.size(lines) > 0.7), "one form of line")
            .when((F.size(words) >= 40) & (distinct / F.size(words) < 0.12), "few different words")
        )

    def parts(raw: Column) -> Column:
        words = F.regexp_extract_all(F.regexp_replace(raw, TAG, " "), F.lit(r"\p{L}[\p{L}\-']{2,}"), F.lit(0))
        lines = F.filter(F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
        return once(F.struct(words.alias("words"), lines.alias("lines")), lambda p: judged(raw, p["words"], p["lines"]))

    return once(F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", ""), parts)


def _longest_run(ordered: Column) -> Column:
    """Most equal neighbours of a sorted array, in one pass."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(ordered, start, step, lambda acc: acc["most"])


def provenance(tags: Column) -> Column:
    """CLS-06: machine, file or written, by the stamp among the tags."""
    low = F.transform(tags, F.lower)
    return F.when(F.array_contains(low, "machine-scan"), "machine").when(F.arrays_overlap(low, F.array(*[F.lit(x) for x in ("import", "inbox", "obsidian", "clip")])), "file").otherwise("written")


def first_mark(tags: Column, marks: list[str]) -> Column:
    """CLS-10: the first of the configured marks that a note carries; null for none."""
    hits = F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.array_contains(tags, m))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))

"""Text functions as Column expressions (STR-*): all stay in the JVM unless their name ends in ``_udf``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query, German and English.
STOPWORDS_DE = [
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines", "und", "oder",
    "aber", "wenn", "dann", "also", "auch", "noch", "schon", "nur", "sehr", "wie", "was", "wer", "wo", "wann",
    "warum", "wieso", "weshalb", "welche", "welcher", "welches", "dass", "ist", "sind", "war", "waren", "sein", "hat",
    "haben", "hatte", "hatten", "wird", "werden", "wurde", "wurden", "kann", "könnte", "soll", "sollen", "muss",
    "müssen", "will", "wollen", "möchte", "möchten", "bei", "mit", "von", "zu", "zum", "zur", "im", "am", "an", "auf",
    "für", "über", "unter", "vor", "nach", "zwischen", "durch", "gegen", "ohne", "um", "aus", "in", "als", "so",
    "diese", "dieser", "dieses", "diesen", "diesem", "jeder", "jede", "jedes", "viele", "vielen", "mehr", "weniger",
    "hier", "dort", "da", "dabei", "damit", "dazu", "darauf", "darüber", "darunter", "nicht", "kein", "keine",
    "keinen", "keinem", "keiner", "nichts", "alles", "etwas", "man", "es", "er", "sie", "wir", "ihr", "mein", "dein",
    "unser", "euer",
]
STOPWORDS_EN = [
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "so", "as", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "than", "too", "very", "can", "will", "just", "don", "should", "now", "is", "are", "was",
    "were", "be", "been", "being", "has", "have", "had", "do", "does", "did", "having", "doing", "am", "isnt",
    "arent", "wasnt", "hasnt", "havent", "hadnt", "dont", "doesnt", "didnt", "wont", "wouldnt", "shouldnt", "cant",
    "cannot", "could", "would", "may", "might", "must", "shall", "this", "that", "these", "those", "i", "me", "my",
    "myself", "we", "our", "ours", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its",
    "they", "them", "their", "what", "which", "who", "whom",
]
STOPWORDS = sorted({*STOPWORDS_DE, *STOPWORDS_EN})
MAX_QUERY_TERMS = 12

#: White space as a browser sees it, which is wider than \s.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is made once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def sanitize_text(c: Column, most: int = 50_000) -> Column:
    """STR-01: control characters out (tab and line ends stay), cut to ``most`` characters, trimmed."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(F.substring(clean, 1, most), rf"^{SPACE}+|{SPACE}+$", "")


def sanitize_html(c: Column, most: int = 50_000) -> Column:
    """STR-02: script blocks, on... handlers and javascript: links out."""
    c = F.regexp_replace(sanitize_text(c, most), r"(?is)<script.*?>.*?</script>", "")
    c = F.regexp_replace(c, r"""(?i)on\w+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(c, r"(?i)javascript:\s*", "")


def sanitize_title(c: Column) -> Column:
    """STR-03: one line of 200 characters at most."""
    return F.trim(F.regexp_replace(sanitize_text(c, 200), r"[\r\n]+", " "))


def sanitize_tags(tags: Column) -> Column:
    """STR-03: lower case, a small character set, 2 to 30 characters, the first 12, distinct."""
    cut = F.transform(tags, lambda t: F.substring(F.regexp_replace(F.trim(F.lower(t)), r"[^a-z0-9\-_äöüß]", ""), 1, 30))
    return F.array_distinct(F.slice(F.filter(cut, lambda t: F.length(t) >= 2), 1, 12))


def chunk_text(c: Column, size: int = 1200, overlap: int = 150) -> Column:
    """STR-04: paragraphs packed up to ``size`` characters; longer ones packed by sentences, carrying ``overlap`` characters over.

    A fold over the paragraphs; a null or blank text has no chunk.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: F.length(p) > 0)

    def pack(pieces: Column, glue: str, carry: int) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def add(acc: Column, p: Column) -> Column:
            fits = F.length(acc["open"]) + len(glue) + F.length(p) <= size
            kept = F.when(F.lit(carry > 0) & (F.length(acc["open"]) > 0), F.concat(F.substring(acc["open"], -carry if carry else 1, carry if carry else 0), F.lit(glue), p)).otherwise(p)
            joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(glue), p))
            flush = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
            return F.struct(F.when(fits, acc["done"]).otherwise(flush).alias("done"), F.when(fits, joined).otherwise(kept).alias("open"))

        return F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))

    long = F.exists(paragraphs, lambda p: F.length(p) > size)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0))))
    return F.when(long, pack(sentences, " ", overlap)).otherwise(pack(paragraphs, "\n\n", 0))


def content_terms(c: Column, most: int = MAX_QUERY_TERMS) -> Column:
    """STR-06: words of two characters or more without stop words, unless nothing else is there; the first ``most``."""
    raw = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda t: F.length(t) > 1)
    meaning = F.filter(raw, lambda t: ~t.isin(STOPWORDS))
    return F.slice(F.when(F.size(meaning) > 0, meaning).otherwise(raw), 1, most)


def client_tokens(c: Column, ngram: int = 1, stop: bool = True) -> Column:
    """STR-07: ASCII and German letters and digits, stop words out, and n-grams joined by _."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9äöüß]+", " "), " "), lambda t: t != "")
    if stop:
        words = F.filter(words, lambda t: ~t.isin(STOPWORDS) & (F.length(t) > 1))

    def joined(words: Column) -> Column:
        out = grams = words
        for n in range(2, ngram + 1):
            # each gram and the word behind it; slices are made once, not once for each place
            count = F.greatest(F.size(words) - (n - 1), F.lit(0))
            grams = F.zip_with(F.slice(grams, 1, count), F.slice(words, n, count), lambda a, b: F.concat_ws("_", a, b))
            out = F.concat(out, grams)
        return out

    return once(words, joined) if ngram > 1 else words


def content_words(title: Column, content: Column) -> Column:
    """Words of title and content: two characters or more, or a digit."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", title, content)), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) > 1) | t.rlike(r"\d"))


def shingles(title: Column, content: Column) -> Column:
    """STR-08: distinct pairs of neighbouring words; a single word stands for itself."""

    def pairs(w: Column) -> Column:
        count = F.greatest(F.size(w) - 1, F.lit(0))
        return F.when(F.size(w) < 2, w).otherwise(F.zip_with(F.slice(w, 1, count), F.slice(w, 2, count), lambda a, b: F.concat_ws(" ", a, b)))

    return F.array_distinct(once(content_words(title, content), pairs))


def normal_form(c: Column) -> Column:
    """STR-09: lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), rf"{SPACE}+", " "))


def stem(c: Column) -> Column:
    """STR-10: one German or English ending off."""
    return F.regexp_replace(c, "(ung|en|er|es|em|e|s|n)$", "")


def wiki_links(c: Column) -> Column:
    """STR-15: names in double brackets, without alias, lower case, distinct."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[\[([^\[\]]{2,80})\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.lower(F.split(x, r"\|")[0]))), lambda x: x != ""))


#: Section labels that are no concepts.
FRAME_WORDS = [
    "fixed", "added", "changed", "removed", "deprecated", "tests", "links", "wiki-links", "usage", "overview",
    "notes", "todo", "faq", "install", "installation", "setup", "config", "configuration", "examples", "example",
    "roadmap", "changelog", "benchmarks", "deployment", "dependencies", "troubleshooting", "license", "contributing",
    "security", "api", "references", "inhalt", "anhang", "quellen", "wiki links",
]


def concepts(c: Column, most: int = 40) -> Column:
    """STR-16: names from Markdown headings and wiki links outside code fences, in order, distinct, ``most`` at most."""
    # fenced blocks go first; one that is not closed reaches to the end
    open_text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?ms)^\s*(```|~~~)[^\n]*$.*?(^\s*(```|~~~)[^\n]*$|\z)", "")
    plain = F.split(open_text, "\n")
    named = F.flatten(F.transform(plain, lambda x: F.concat(F.filter(F.array(F.regexp_extract(x, r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)), lambda h: h != ""), F.regexp_extract_all(x, F.lit(r"\[\[([^\[\]]{2,80})\]\]"), F.lit(1)))))
    flat = F.transform(named, lambda x: F.lower(F.trim(F.regexp_replace(F.split(x, r"\|")[0], r"\s+", " "))))

    def is_name(n: Column) -> Column:
        sentence = n.endswith(".") & (F.length(F.regexp_replace(F.element_at(F.split(n, " "), -1), r"\.$", "")) > 3)
        return F.length(n).between(4, 40) & n.rlike(r"^[\p{L}\p{N}][\p{L}\p{N} .'&-]*$") & n.rlike(r"\p{L}") & (F.size(F.split(n, " ")) <= 4) & ~sentence & ~n.isin(FRAME_WORDS)

    return F.slice(F.array_distinct(F.filter(flat, is_name)), 1, most)


def todos(c: Column) -> Column:
    """STR-22: open check-list items, markup stripped, 200 characters."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?m)^[ \t]*[-*] \[ \] (.+)$"), F.lit(1))
    clean = F.transform(found, lambda x: F.substring(F.trim(F.regexp_replace(F.regexp_replace(x, r"\[\[([^\]|]+)(\|[^\]]*)?\]\]", "$1"), "[*_`]+", "")), 1, 200))
    return F.filter(clean, lambda x: x != "")


def title_of(c: Column) -> Column:
    """STR-27: the first line with text, leading markup off, 120 characters."""
    line = F.element_at(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1)
    return F.substring(F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"^[#>*\-\s]+", "")), 1, 120)


def file_name(c: Column) -> Column:
    """STR-23: a safe file name of 80 characters, ``note`` if nothing is left."""
    clean = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', " "), r"\s+", " ")), 1, 80)
    return F.when(F.trim(clean) == "", "note").otherwise(F.trim(clean))


def yaml_value(c: Column) -> Column:
    """STR-23: quoted where YAML would read something else than this text."""
    escaped = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.rlike(r"""[:#\[\]{},&*?|<>=!%@`"'\n]|^[\s-]|\s$|^$"""), escaped).otherwise(c)


def source_of(c: Column) -> Column:
    """STR-20: the ``Source:`` line of a note as a struct (kind, name, path, ext)."""
    path = F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?m)^(?:— ?)?(?:Source|Quelle): *([^\n]+)$", 1))
    name = F.regexp_extract(path, r"([^/\\]+)/?$", 1)
    kind = F.when(path == "", "none").when(path.rlike("^https?://"), "url").otherwise("file")
    return F.struct(kind.alias("kind"), name.alias("name"), path.alias("path"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))


def part_of_title(c: Column) -> Column:
    """STR-21: ``base — Teil i/n`` titles as a struct (base, part, parts); part 0 where there is none."""
    at = r"\s+—\s+(?:Teil\s+)?(\d+)/(\d+)$"
    return F.struct(
        F.regexp_replace(c, at, "").alias("base"),
        F.when(c.rlike(at), F.regexp_extract(c, at, 1).cast("int")).otherwise(0).alias("part"),
        F.when(c.rlike(at), F.regexp_extract(c, at, 2).cast("int")).otherwise(0).alias("parts"),
    )


#: Tags whose content goes with them, and block ends that are line ends.
_SILENT = ("script", "style", "head", "noscript", "svg")
_NAVIGATION = (
    r"(?i)^(skip to (main )?content|jump to (content|navigation)|(main )?(menu|navigation)|search|log ?in|log ?out|sign ?in|sign ?up|register|subscribe|newsletter"
    r"|home|startseite|impressum|datenschutz|kontakt|contact( us)?|about( us)?|faq|agb|imprint|share|tweet|print|rss|feed"
    r"|accept all|alle akzeptieren|cookies? (akzeptieren|akzept|settings|erlauben)|read more|weiterlesen|mehr lesen|©.*|copyright([^A-Za-z0-9_].*)?)$"
)


def html_text(c: Column) -> Column:
    """STR-13: readable text of an HTML page, navigation lines dropped."""
    c = F.coalesce(c, F.lit(""))
    for tag in _SILENT:
        c = F.regexp_replace(c, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}>", " ")
    for pattern, by in (
        (r"(?s)<!--.*?-->", " "),
        (r"(?i)</(p|div|li|tr|h[1-6]|section|article|blockquote)>", "\n"),
        (r"(?i)<br\s*/?>", "\n"),
        (r"<[^>]+>", " "),
        ("(?i)&nbsp;", " "),
        ("(?i)&amp;", "&"),
        ("(?i)&lt;", "<"),
        ("(?i)&gt;", ">"),
        ("(?i)&quot;", '"'),
        ("&#39;", "'"),
        (r"[ \t]+", " "),
        (r"[ \t]*\n[ \t]*", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, by)
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.split(c, "\n"), lambda x: ~((F.length(F.trim(x)).between(1, 60)) & F.trim(x).rlike(_NAVIGATION)))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def index_tokens(title: Column, content: Column, tags: Column) -> Column:
    """Tokens of the full-text index: title, content and tags, folded."""
    text = fold_accents(F.concat_ws(" ", title, content, F.array_join(tags, " ")))
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def token_estimate(c: Column) -> Column:
    """MTH-13."""
    return F.ceil(F.length(c) / 3.5)

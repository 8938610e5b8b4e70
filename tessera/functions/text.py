"""Scalar text functions as column expressions: tokens, estimates, chunks, scores, ids, classes. All run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?U)\b\w+\b"

# Fixed values of the data model.
MODALITY_SUFFIXES = {
    "text": ["txt", "md", "rst", "log", "csv", "tsv", "json", "xml", "html", "htm", "yaml", "yml", "pdf", "doc", "docx", "ppt", "pptx", "rtf", "xls", "xlsx", "ods"],
    "image": ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff"],
    "video": ["mp4", "mov", "mkv", "avi", "webm", "m4v"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg", "aac"],
}
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "swift": "swift", "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "c": "c", "h": "c", "hpp": "cpp", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "ps1": "powershell", "toml": "toml", "yaml": "yaml", "yml": "yaml",
    "json": "json", "xml": "xml", "ini": "ini", "cfg": "config", "conf": "config", "env": "env", "md": "markdown", "txt": "text",
}
LANGUAGE_NAMES = {"dockerfile": "dockerfile", "makefile": "make", "cmakelists.txt": "cmake"}


def tokens(text) -> Column:
    """Words of the lower-cased text, in order, repeats kept; null: none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def token_estimate(n_words: Column) -> Column:
    """1.35 tokens a word, half to even, at least 1."""
    return F.greatest(F.bround(n_words * F.lit(1.35), 0).cast("int"), F.lit(1))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlap; an empty part: 0."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunk_config(length: Column) -> tuple[Column, Column]:
    """Characters and overlap for a text of this length."""
    size = F.when(length <= 1200, 520).when(length <= 5000, 780).otherwise(950)
    overlap = F.when(length <= 1200, 60).when(length <= 5000, 100).otherwise(140)
    return size, F.least(overlap, F.floor(size / 3).cast("int"))


def char_chunks(text: Column, size: Column, overlap: Column) -> Column:
    """array<struct<index, start, end, text>>: windows of size characters with overlap; blank ones are left out and take no index."""
    step, n = F.greatest(F.lit(1), size - overlap), F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    pieces = F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(s + size, n).cast("int").alias("end"), strip(F.substring(text, s + 1, size)).alias("text")))
    full = F.filter(pieces, lambda p: p["text"] != "")
    return F.when(n > 0, F.transform(full, lambda p, i: F.struct(i.cast("int").alias("index"), p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"))))


def line_chunks(text: Column, size: int, overlap: int) -> Column:
    """array<struct<index, start_line, end_line, text>>: windows of lines, numbered from 1; blank ones are left out."""
    lines = F.split(F.regexp_replace(text, r"\r\n|[\r\x0B\f\x1c-\x1e\x85  ]", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    step, n = max(1, size - overlap), F.size(lines)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step + 1).alias("start_line"), F.least(i * step + size, n).alias("end_line"), strip(F.array_join(F.slice(lines, i * step + 1, size), "\n")).alias("text")))
    full = F.filter(pieces, lambda p: p["text"] != "")
    return F.transform(full, lambda p, i: F.struct(i.cast("int").alias("index"), p["start_line"].cast("int").alias("start_line"), p["end_line"].cast("int").alias("end_line"), p["text"].alias("text")))


def chunk_score(query_tokens: Column, query: Column, text: Column) -> Column:
    """hits + 0.35 unique + 10 hits / words + 250 proximity + 2.5 phrase over the lower-cased chunk.

    Hits are substrings of each distinct token; proximity is 1 / (1 + span) of the first whole-word places of the query's tokens,
    repeats kept, if there are at least two; a query without tokens scores 1.
    """
    low = F.lower(text)
    counts = F.transform(F.array_distinct(query_tokens), lambda t: occurrences(low, t))
    hits = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    unique = F.size(F.filter(counts, lambda c: c > 0))
    places = F.filter(F.transform(query_tokens, lambda t: F.expr("1") * F.regexp_instr(low, F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b")))), lambda p: p > 0)
    near = F.when(F.size(places) >= 2, 1.0 / (1.0 + F.array_max(places) - F.array_min(places))).otherwise(0.0)
    phrase = F.when((F.length(query) >= 4) & F.contains(low, F.lower(query)), 1.0).otherwise(0.0)
    score = hits + unique * 0.35 + hits / F.greatest(F.lit(1), words(low)) * 10 + near * 250 + phrase * 2.5
    return F.when(F.size(query_tokens) == 0, F.lit(1.0)).otherwise(score)


def text_chunk_id(file_id: Column, index: Column, size: Column, overlap: Column) -> Column:
    """URL-safe base64, unpadded, of the compact JSON that names a chunk."""
    json = F.to_json(F.struct(file_id.alias("fid"), index.alias("idx"), size.alias("cc"), overlap.alias("ov")))
    return F.rtrim(F.translate(F.base64(F.encode(json, "UTF-8")), "+/", "-_"), F.lit("="))


def code_chunk_id(path: Column, index: Column, lines: Column, overlap: Column) -> Column:
    """As text_chunk_id(), for a chunk of lines of a file of code."""
    json = F.to_json(F.struct(path.alias("p"), index.alias("idx"), lines.alias("cl"), overlap.alias("ov")))
    return F.rtrim(F.translate(F.base64(F.encode(json, "UTF-8")), "+/", "-_"), F.lit("="))


def short_number(n: Column) -> Column:
    """A count with K or M from a thousand and a million on; N/A below 0."""
    short = lambda size, mark: F.format_string(f"%.1f{mark}", n / F.lit(float(size)))
    return F.when(n < 0, "N/A").when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "K")).otherwise(n.cast("string"))


def sparkline(values: Column, ticks: str = "▁▂▃▄▅▆▇█") -> Column:
    """A tick for each number of an array, from the lowest to the highest; of equal ones full ticks, of zeros dots; none: empty."""
    low, high, top = F.array_min(values), F.array_max(values), len(ticks) - 1
    place = lambda v: F.bround((v - low) / (high - low) * top, 0).cast("int")
    drawn = F.array_join(F.transform(values, lambda v: F.substring(F.lit(ticks), F.greatest(F.lit(0), F.least(F.lit(top), place(v))) + 1, F.lit(1))), "")
    flat = F.repeat(F.when(low == 0, "·").otherwise(ticks[-1]), F.size(values))
    return F.when(F.size(values) == 0, "").when(low == high, flat).otherwise(drawn)


def is_noisy(query: Column) -> Column:
    t = tokens(query)
    return F.when(F.size(t) == 0, False).otherwise((F.size(t) <= 2) | F.exists(t, lambda x: F.length(x) <= 3) | query.rlike(r"(?U)[^\w\s]"))


def lane_weights(mode: Column, noisy: Column) -> Column:
    pair = lambda a, b: F.struct(F.lit(a).alias("word"), F.lit(b).alias("trigram"))
    return F.when(mode == "bm25_only", pair(1.0, 0.0)).when(mode == "trigram_only", pair(0.0, 1.0)).when(noisy, pair(1.0, 0.55)).otherwise(pair(1.0, 0.2))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def modality(path: Column) -> Column:
    s, out = suffix(path), None
    for name, suffixes in MODALITY_SUFFIXES.items():
        out = F.when(s.isin(suffixes), name) if out is None else out.when(s.isin(suffixes), name)
    return out.otherwise("unknown")


def language(path: Column) -> Column:
    """By the file's name, in any case, or else its suffix."""
    of = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(of(LANGUAGE_NAMES), F.lower(F.element_at(F.split(path, "/"), -1))), F.try_element_at(of(LANGUAGES), suffix(path)), F.lit("unknown"))


def name_style(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+$"), "snake").when(name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab")
        .when(name.rlike(r"^[a-z]+([A-Z][a-z0-9]*)+$"), "camel").otherwise("other")
    )


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")

"""Readers and writers for record files: JSON lines, Markdown, annotation exports."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from strandweave.shared import free_name


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """One JSON object a line; blank lines are skipped, and with `tolerant` malformed lines too."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """book_id (file stem), collection (folder), source_file (front matter), text without front matter."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    front = r"^---\n([\s\S]*?)\n---\n?"
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("book_id"),
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("collection"),
        F.regexp_extract(F.regexp_extract("value", front, 1), r"(?m)^source_file:\s*\"?(.*?)\"?\s*$", 1).alias("source_file"),
        F.regexp_replace("value", front, "").alias("text"),
    )


def replace_books(current: DataFrame, new: DataFrame) -> DataFrame:
    """`current` with the books of `new` replaced by `new`'s rows."""
    return current.join(new.select("book_id").distinct(), "book_id", "left_anti").unionByName(new)


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of `listing` (path, content) whose SHA-256 the manifest (path, sha256) doesn't have."""
    hashed = listing.select("path", F.sha2("content", 256).alias("sha256"))
    return hashed.join(manifest, ["path", "sha256"], "left_anti")


def upsert(current: DataFrame, new: DataFrame, key: str, refreshed: str = "note") -> DataFrame:
    """Inserts the rows of `new` whose key is unknown; of a known one only `refreshed` is taken.  Of repeats in `new` the least row counts."""
    row, own, taken = (free_name([*current.columns, *new.columns], n) for n in ("row", "known_key", "taken"))
    one = new.groupBy(key).agg(F.min(F.struct(*(c for c in new.columns if c != key))).alias(row)).select(key, f"{row}.*")
    notes = one.select(F.col(key).alias(own), F.col(refreshed).alias(taken))
    kept = current.join(notes, F.col(key) == F.col(own), "left")
    kept = kept.withColumn(refreshed, F.when(F.col(own).isNotNull(), F.col(taken)).otherwise(F.col(refreshed))).select(*current.columns)
    return kept.unionByName(one.join(current.select(key), key, "left_anti").select(*current.columns))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line: overwrites the folder, or adds files to it."""
    df.write.mode("append" if append else "overwrite").json(path)


def without_book(events: DataFrame, book: object) -> DataFrame:
    """A log without one book's rows; rows without a book stay."""
    return events.where(~F.col("book").eqNullSafe(F.lit(book)) | F.col("book").isNull())


#: Names that exports give the quote, the note and the list of records.
QUOTE_KEYS = ("quote", "text", "highlight", "highlighted_text", "highlightedText", "selected_text", "selectedText", "content", "body")
NOTE_KEYS = ("note", "notes", "comment", "annotation", "remark")
LIST_KEYS = ("highlights", "annotations", "bookmarks", "items", "entries", "notes")

Pairs = Iterator[tuple[str, str]]


def _flat(value) -> str:
    return " ".join(str(value).split())


def _first(row: dict, keys: tuple[str, ...]) -> str:
    return next((_flat(row[k]) for k in keys if isinstance(row.get(k), str) and row[k].strip()), "")


def markdown_annotations(text: str) -> Pairs:
    """(quote, note) of ==highlights==, then of block quotes; one plain line right after a quote is its note."""
    for found in re.finditer(r"==(.+?)==", text, re.S):
        if quote := _flat(found[1]):
            yield quote, ""
    held: list[str] = []
    for line in [*text.splitlines(), None]:
        bare = (line or "").lstrip()
        if bare.startswith(">"):
            held.append(bare[1:])
        elif held:
            quote, held = _flat(" ".join(held)), []
            if quote:
                yield quote, "" if not bare.strip() or bare.startswith("#") else bare.strip().lstrip("—-").strip()


def json_annotations(text: str) -> Pairs:
    """(quote, note) of a list of records or strings, bare, under a known name, or of an object whose values are all records."""
    data = json.loads(text)
    if isinstance(data, dict):
        named = next((data[k] for k in LIST_KEYS if isinstance(data.get(k), list)), None)
        values = list(data.values())
        data = named if named is not None else values if values and all(isinstance(v, dict) for v in values) else []
    for entry in data if isinstance(data, list) else ():
        quote, note = (_flat(entry), "") if isinstance(entry, str) else (_first(entry, QUOTE_KEYS), _first(entry, NOTE_KEYS)) if isinstance(entry, dict) else ("", "")
        if quote:
            yield quote, note


def csv_annotations(text: str) -> Pairs:
    """(quote, note) by the names in the first row, else of the first two columns of all rows."""
    rows = list(csv.reader(io.StringIO(text)))
    names = [c.strip().lower() for c in rows[0]] if rows else []
    at = lambda keys: next((i for i, c in enumerate(names) if c in keys), None)
    quote_at, note_at = at(QUOTE_KEYS), at(NOTE_KEYS)
    if quote_at is None:
        quote_at, note_at = 0, 1 if len(names) > 1 else None
    else:
        rows = rows[1:]
    for row in rows:
        if quote_at < len(row) and (quote := _flat(row[quote_at])):
            yield quote, _flat(row[note_at]) if note_at is not None and note_at < len(row) else ""


_LUA_TABLE = re.compile(r'\["(?:annotations|highlights|bookmarks)"\]\s*=\s*\{')
_LUA_FIELD = re.compile(r'\["(text|note)"\]\s*=\s*"((?:[^"\\]|\\.)*)"', re.S)
_LUA_ESCAPES = {"n": "\n", "t": "\t"}


def lua_annotations(text: str) -> Pairs:
    """(text, note) of an e-reader's Lua sidecar: in its table of highlights each text begins a record."""
    table = _LUA_TABLE.search(text)
    clean = lambda s: _flat(re.sub(r"\\(.)", lambda m: _LUA_ESCAPES.get(m[1], m[1]), s, flags=re.S))
    quote = note = ""
    for field in _LUA_FIELD.finditer(text, table.end() if table else 0):
        if field[1] == "note":
            note = clean(field[2])
            continue
        if quote:
            yield quote, note
        quote, note = clean(field[2]), ""
    if quote:
        yield quote, note


FORMATS = {"md": markdown_annotations, "json": json_annotations, "csv": csv_annotations, "koreader": lua_annotations}


def parsed(filename: str, text: str) -> tuple[str, list[tuple[str, str]]]:
    """(format, pairs): by the name, else by how the text looks; what isn't JSON after all is read as CSV."""
    name = filename.lower()
    if name.endswith((".md", ".markdown")):
        return "md", list(markdown_annotations(text))
    if name.endswith(".lua") or _LUA_TABLE.search(text):
        return "koreader", list(lua_annotations(text))
    if name.endswith(".json") or text.lstrip()[:1] in ("[", "{") or not (name.endswith(".csv") or "," in text):
        try:
            return "json", list(json_annotations(text))
        except ValueError:
            pass
    return "csv", list(csv_annotations(text))


@udtf(returnType="fmt string, pos int, quote string, note string")
class ImportAnnotations:
    """(filename, content) to one row per annotation, for any format known."""

    def eval(self, filename: str, content: str):
        fmt, pairs = parsed(filename or "", content or "")
        for i, (quote, note) in enumerate(pairs):
            yield fmt, i, quote, note

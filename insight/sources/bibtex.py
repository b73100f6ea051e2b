"""Bibliography text as a Spark job: one row per entry with a map of its fields.

The text source cuts files at ``\\n@`` (so files split across tasks); a small
helper walks each piece once, following the depth of braces, and yields the
entries in it.  Field names are matched case-insensitively (``DOI`` / ``doi``),
values may be brace- or quote-delimited, bare, joined by ``#``, double-braced, on
one line or spanning several; entries may stand in braces or parentheses, be
indented, or follow one another in a line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields pulled out of each entry by default.
DEFAULT_FIELDS = ("title", "journal", "year", "doi", "author")


def _entries():
    """Task side: pieces (value, file) -> (entry_type, key, fields).  Everything is made inside, so that workers need no
    module of ours."""
    import re

    opening = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
    key = re.compile(r"\s*([^\s,{}()=\"]*)\s*(,|(?=[})]))")
    record = re.compile(r"\s*(?!(?:comment|string|preamble)\b)[A-Za-z]+\s*[{(]\s*[^\s,{}()=\"]+\s*,", re.I)
    name = re.compile(r"[\s,]*([^\s,={}()\"#@]+)\s*=\s*")
    bare = re.compile(r"[^\s,#{}()\"]+")
    joint = re.compile(r"\s*#\s*")
    brace = re.compile(r"[{}]")
    mark = re.compile(r"[{}\"]")
    skip = {"comment", "string", "preamble"}

    def closed(text, at):
        """Where the brace that opens at ``at`` is closed, or -1."""
        depth = 0
        for m in brace.finditer(text, at):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return m.start()
        return -1

    def quoted(text, at):
        """Where the quote that opens at ``at`` ends: the next one outside braces, or -1."""
        depth = 0
        for m in mark.finditer(text, at + 1):
            if m[0] == '"' and depth <= 0:
                return m.start()
            depth += {"{": 1, "}": -1}.get(m[0], 0)
        return -1

    def value(text, at):
        """(value, end) of what stands at ``at``; no value where a brace or quote is never closed."""
        parts = []
        while True:
            if text.startswith("{", at):
                end = closed(text, at)
                parts.append(text[at + 1:end])
            elif text.startswith('"', at):
                end = quoted(text, at)
                parts.append(text[at + 1:end])
            else:
                m = bare.match(text, at)
                end = m.end() - 1 if m else -1
                parts.append(m[0] if m else "")
            if end < 0:
                return None, -1
            m = joint.match(text, end + 1)
            if not m:
                break
            at = m.end()
        whole = "".join(parts)
        # one outer pair goes, where the first brace's partner is the last one
        if whole.startswith("{") and closed(whole, 0) == len(whole) - 1:
            whole = whole[1:-1]
        return " ".join(whole.split()) or None, end + 1

    def found(text):
        """(type, key, fields) of the entries of a piece, and where the last one ends."""
        at = 0
        while m := opening.search(text, at):
            kind, at = m[1].lower(), m.end()
            if kind in skip:
                end = closed(text, at - 1) if m[2] == "{" else text.find(")", at)
                at = end + 1 if end >= 0 else len(text)
                continue
            k = key.match(text, at)
            label = k[1] or None if k else None
            at = k.end() if k else at
            fields = {}
            while f := name.match(text, at):
                content, end = value(text, f.end())
                if end < 0:
                    at = len(text)
                    break
                if content is not None:
                    fields.setdefault(f[1].lower(), content)
                at = end
            yield kind, label, fields

    def depth(text):
        return text.count("{") - text.count("}")

    def run(batches):
        import pyarrow as pa

        def rows(texts):
            kinds, keys, maps = [], [], []
            for text in texts:
                for kind, label, fields in found(text):
                    kinds.append(kind)
                    keys.append(label)
                    maps.append(list(fields.items()))
            return pa.record_batch([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(maps, pa.map_(pa.string(), pa.string()))],
                                   names=["entry_type", "key", "fields"])

        held, held_file, level = [], None, 0
        for batch in batches:
            done = []
            for piece, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
                # a piece goes on with the one before it while that has an open brace and no new record begins
                if held and (file != held_file or level <= 0 or record.match(piece)):
                    done.append("\n@".join(held))
                    held, level = [], 0
                held.append(piece if held else "@" + piece)
                held_file, level = file, level + depth(piece)
            yield rows(done)
        if held:
            yield rows(["\n@".join(held)])

    return run


def scan_entries(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per bibliography entry: entry_type, key, fields (names in lower case, the first of a name counts).

    Of a value one outer pair of braces or quotes is removed and inner white space
    collapses to a blank; empty values are left out, and so are ``@comment``,
    ``@string`` and ``@preamble`` blocks.  A line that begins with ``@`` inside a
    value does not end the entry, unless it looks like a record itself
    (``@word{key,``): then the entry before it has lost a brace, and ends there
    with the fields read so far.  (An ``@`` line of a value that lies on the border
    of two splits of one file is taken for a border of entries.)"""
    raw = spark.read.option("lineSep", "\n@").text(path).select(
        F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    return raw.mapInArrow(_entries(), "entry_type string, key string, fields map<string, string>")


def parse_entries(entries: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    """(entry_type, key, field...) per entry; null where it lacks the field."""
    return entries.select("entry_type", "key", *[F.try_element_at("fields", F.lit(f.lower())).alias(f) for f in fields])


def scan_bib(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    return parse_entries(scan_entries(spark, path), fields)


def render_entries(df: DataFrame, entry_type: str | Column, key: str | Column,
                   fields: Mapping[str, str | Column], out: str = "value") -> DataFrame:
    """Entry text per row; null fields are skipped (``concat_ws`` drops nulls)."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x

    lines = [F.concat(F.lit("@"), c(entry_type), F.lit("{"), c(key), F.lit(","))]
    for name, value in fields.items():
        v = c(value)
        lines.append(F.when(v.isNotNull(), F.concat(F.lit(f"  {name} = {{"), v, F.lit("},"))))
    lines.append(F.lit("}"))
    return df.select("*", F.concat_ws("\n", *lines).alias(out))

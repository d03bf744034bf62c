"""Codebooks from SPSS syntax files, as one job over a folder.

A file is cut into statements once. One pass over a statement marks its names, quoted texts, numbers and signs with a character of
their own each, so that what follows are patterns over single characters: linear in the statement, however long it is. Each kind of
statement is read into pieces: a label, a comment, a coded label, missing ranges or a format, for one variable or several.
Pieces and the words of the statement leave as rows of one shape and meet in two aggregations, by code and by variable.

Statements come from whole texts (``statements``) or from lines of files that are cut anywhere (``statements_of_lines``), so that a file
of any size spreads over the cluster.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.small import fence

# The statements that carry variable information.
KEYWORDS = ("VARIABLE LABELS", "COMMENT TO", "VALUE LABELS", "MISSING VALUES", "FORMATS")

DEFAULT_FORMAT = "F8.0"
_NAME = r"[\p{L}_@#$][\p{L}\p{N}_.@#$]*(?<!\.)"
_TEXT = r'"[^"]*+(?:""[^"]*+)*+"|' + r"'[^']*+(?:''[^']*+)*+'"
# one group for each kind of token: name, text, slash, number, other sign
_TOKEN = rf"({_NAME})|({_TEXT})|(/)|(-?\d+(?:\.\d+)?)|([().,:])|[\s\S]"
# the characters that stand before a token of each kind
NAME, TEXT, SLASH, NUMBER, SIGN = "\x02", "\x03", "\x04", "\x05", "\x06"
_ANY = "[\x02-\x06]"
_REST = "([^\x02-\x06]*)"
_END = r"(?:LOWEST|LO|HIGHEST|HI|-?\d+)"
_PIECE = ("struct<what:string,var:string,first:int,second:int,code:int,text:string,"
          "ranges:array<struct<lo:int,hi:int>>>")


_WORDS = "|".join(k.replace(" ", r"[ \t]+") for k in KEYWORDS)
_OPENING = rf"(?i)^\s*({_WORDS})\b"


def _opened(cut: DataFrame) -> DataFrame:
    """(file, pos, kind, body) of statements; what opens with no keyword is none."""
    opening = F.regexp_extract("statement", _OPENING, 1)
    return cut.select("file", "pos", F.upper(F.regexp_replace(opening, r"\s+", " ")).alias("kind"),
                      F.regexp_replace("statement", _OPENING, "").alias("body")).filter("kind <> ''")


def statements(files: DataFrame) -> DataFrame:
    """(file, pos, kind, body) from (file, text): a statement starts on a line that starts with a keyword; what stands before
    the first one is none."""
    lines = F.regexp_replace("text", "\r\n?", "\n")
    cut = _opened(files.select("file", F.posexplode(F.split(lines, rf"(?im)(?=^[ \t]*(?:{_WORDS})\b)")).alias("pos", "statement")))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(parts, "file", "pos")  # a few long files are read by a few tasks, their statements by all


def statements_of_lines(lines: DataFrame) -> DataFrame:
    """The same from (file, block, at, line): lines of files that were cut into blocks, in order of block and place.

    A line belongs to the last statement that starts at or before it, which may be in an earlier block: starts are counted in each block, and
    the counts of the blocks before a block, one row each, are added. No task holds more than a block or a statement."""
    starts = F.col("line").rlike(rf"(?i)^[ \t]*(?:{_WORDS})\b").cast("long")
    marked = lines.select("file", "block", "at", "line", starts.alias("start"))
    blocks = marked.groupBy("file", "block").agg(F.sum("start").alias("starts"))
    before = blocks.select(F.col("file").alias("of"), F.col("block").alias("of_block"), F.coalesce(F.expr(
        "sum(starts) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("before"))
    counted = marked.withColumn("number", F.expr("sum(start) OVER (PARTITION BY file, block ORDER BY at)"))
    placed = counted.join(before, (F.col("file") == F.col("of")) & (F.col("block") == F.col("of_block")))
    grouped = placed.groupBy("file", (F.col("number") + F.col("before")).alias("pos")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "at", "line")))["line"], "\n").alias("statement"))
    return _opened(grouped.filter("pos > 0"))


def _marked(body: Column) -> Column:
    """The tokens of a statement, each behind the character of its kind."""
    every = F.regexp_replace(F.translate(body, "\x01\x02\x03\x04\x05\x06", ""), _TOKEN,
                             f"{NAME}$1{TEXT}$2{SLASH}$3{NUMBER}$4{SIGN}$5")
    return F.regexp_replace(every, f"{_ANY}+(?={_ANY}|$)", "")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _unquoted(token: Column) -> Column:
    quote = F.substring(token, 1, 1)
    return F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.concat(quote, quote), quote)


def _piece(what: str, var: Column, first: Column, second: Column | int = 0, code: Column | None = None,
           text: Column | None = None, ranges: Column | None = None) -> Column:
    second = F.lit(second) if isinstance(second, int) else second
    none = F.lit(None)
    return F.struct(F.lit(what).alias("what"), var.alias("var"), first.cast("int").alias("first"), second.cast("int").alias("second"),
                    (none if code is None else code).cast("int").alias("code"),
                    (none if text is None else text).cast("string").alias("text"),
                    (none if ranges is None else ranges).cast("array<struct<lo:int,hi:int>>").alias("ranges"))


def _labels() -> Column:
    """A text right after a name is its label."""
    def found(tokens: Column) -> Column:
        pairs = F.arrays_zip(*[_all(tokens, f"{NAME}{_REST}{TEXT}{_REST}", k).alias(c) for k, c in ((1, "name"), (2, "text"))])
        return F.filter(F.transform(pairs, lambda p, i: _piece("label", p["name"], i, text=_unquoted(p["text"]))), lambda p: p["text"] != "")

    return _once(_marked(F.col("body")), found)


def _coded_labels() -> Column:
    """Names open a group, each number followed by a text is a code of all its names, and a slash or the next name ends it. So a
    group runs to its first text over anything but slashes, and on from there over anything but names and slashes."""
    def of_group(group: Column, i: Column) -> Column:
        pairs = F.arrays_zip(*[_all(group, f"{NUMBER}{_REST}{TEXT}{_REST}", k).alias(c) for k, c in ((1, "code"), (2, "text"))])
        coded = F.filter(F.transform(pairs, lambda p, k: _piece("value", F.lit(""), i, k, p["code"].try_cast("int"), _unquoted(p["text"]))),
                         lambda p: p["code"].isNotNull() & (p["text"] != ""))
        names = _all(group, f"{NAME}{_REST}", 1)
        return F.flatten(F.transform(names, lambda n: F.transform(coded, lambda p: p.withField("var", n))))

    groups = F.filter(_all(_marked(F.col("body")), f"{SLASH}?[^{TEXT}{SLASH}]*[^{NAME}{SLASH}]*", 0), lambda g: g.contains(TEXT))
    return F.flatten(F.transform(groups, of_group))


def _ranges(spec: Column) -> Column:
    """``1 thru 3, -9, LO thru 0`` as (lo, hi) pairs, an open end as null; what is neither is left out."""
    parts = F.regexp_extract_all(spec, F.lit(rf"(?i){_END}\s+THRU\s+{_END}|[^\s,]+"), F.lit(0))

    def pair(part: Column) -> Column:
        ends = F.split(F.upper(part), r"\s+THRU\s+")
        low, high = F.get(ends, F.lit(0)), F.element_at(ends, -1)
        whole = F.size(ends) == 2
        lo, hi = low.try_cast("int"), high.try_cast("int")
        from_lowest, to_highest = whole & low.startswith("LO"), whole & high.startswith("HI")
        good = (from_lowest | lo.isNotNull()) & (to_highest | hi.isNotNull()) & F.coalesce(lo <= hi, F.lit(True))
        return F.when(good, F.struct(lo.alias("lo"), hi.alias("hi")))

    return F.filter(F.transform(parts, pair), lambda r: r.isNotNull())


def _in_parentheses(what: str) -> Column:
    """``names (content)`` groups: the content counts for each of the names."""
    group = r"(?<![^()/])([^()/]*+)\(([^)]*+)\)"
    names, contents = (_all(F.col("body"), group, k) for k in (1, 2))

    def of_group(g: Column, i: Column) -> Column:
        content = g["content"]
        more = {"ranges": _ranges(content)} if what == "missing" else {"text": content}
        return F.transform(F.regexp_extract_all(g["names"], F.lit(_NAME), F.lit(0)),
                           lambda v, k: _piece(what, v, i, k, **more))

    return F.flatten(F.transform(F.arrays_zip(names.alias("names"), contents.alias("content")), of_group))


def _comment() -> Column:
    """The lines after the name, trimmed and joined."""
    name = F.regexp_extract("body", rf"^\s*({_NAME})\s*:", 1)
    lines = F.split(F.regexp_replace("body", rf"^\s*{_NAME}\s*:", ""), "\n")
    text = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " ")
    return F.filter(F.array(_piece("comment", name, F.lit(0), text=text)), lambda p: p["var"] != "")


def _mentions() -> Column:
    words = F.array_distinct(F.regexp_extract_all("body", F.lit(_NAME), F.lit(0)))
    return F.transform(words, lambda w, i: _piece("mention", w, i))


def _once(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def pieces(cut: DataFrame) -> DataFrame:
    """(file, what, var, place, code, text, ranges) of everything the statements define, and of the words they mention."""
    kind = F.col("kind")
    mined = (F.when(kind == "VARIABLE LABELS", _labels()).when(kind == "COMMENT TO", _comment())
             .when(kind == "VALUE LABELS", _coded_labels()).when(kind == "MISSING VALUES", _in_parentheses("missing"))
             .when(kind == "FORMATS", _in_parentheses("format")))
    rows = cut.select("file", "pos", F.concat(mined, _mentions()).alias("pieces"))
    return (fence(rows, "pieces").select("file", "pos", F.inline("pieces"))
            .select("file", "what", "var", F.struct("pos", "first", "second").alias("place"), "code", "text", "ranges"))


def codebook(files: DataFrame) -> DataFrame:
    """The codebook of whole files, (file, text)."""
    return codebook_of(statements(files))


def codebook_of(cut: DataFrame) -> DataFrame:
    """One row per file and variable (label, comment, value_labels, missing, format), in order
    of first mention. The last definition in a file wins, for value labels code by code. ``missing`` holds ranges
    (lo, hi); ``missing_codes`` lists their codes."""
    last = pieces(cut).groupBy("file", "var", "what", "code").agg(
        F.max_by("text", "place").alias("text"), F.max_by("ranges", "place").alias("ranges"), F.min("place").alias("place"))
    what = F.col("what")

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.max(F.when(what == name, F.col("text"))), F.lit(default)).alias(name)

    labels = F.collect_list(F.when(what == "value", F.struct("code", "text")))
    return (last.groupBy("file", "var").agg(
        text("label", ""), text("comment", ""),
        F.map_from_entries(F.sort_array(labels)).alias("value_labels"),
        F.coalesce(F.first(F.when(what == "missing", F.col("ranges")), ignorenulls=True),
                   F.array().cast("array<struct<lo:int,hi:int>>")).alias("missing"),
        text("format", DEFAULT_FORMAT), F.min(F.when(what == "mention", F.col("place"))).alias("seen"),
        F.bool_or(what != "mention").alias("defined"))
        .filter("defined").drop("defined").orderBy("file", "seen").drop("seen"))


def missing_codes(book: DataFrame, step: int = 10_000) -> DataFrame:
    """(file, var, code): a row for every code of the missing ranges, which are cut into steps before they are counted out. Ranges with an open
    end (``LO``, ``HI``) hold no codes that could be listed; they stay in ``missing``, and :func:`open_ranges` has them."""
    ranges = book.select("file", "var", F.inline("missing")).where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    starts = ranges.select("file", "var", "hi", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"),
                                                                     F.lit(step).cast("long"))).alias("at"))
    codes = F.sequence("at", F.least(F.col("at") + (step - 1), F.col("hi").cast("long")))
    return starts.select("file", "var", F.explode(codes).alias("code"))


def open_ranges(book: DataFrame) -> DataFrame:
    """(file, var, lo, hi) of the missing ranges with an open end, which is null."""
    return book.select("file", "var", F.inline("missing")).where(F.col("lo").isNull() | F.col("hi").isNull())

"""Generated, minified and vendored source files, and data stored as code (problem 3).

Per file, in one pass: its folder, its opening and closing notices, its token composition, its
program text (code lines without comments and white space at their ends). Across files:

1. Files of equal program text, by a 128-bit hash of its lines and strings, are one program; one that stands in at least three
   repositories is third-party, however short it is.
2. An inverted index from line hashes to programs finds edited copies: the rarest lines of each third-party program lead to the
   programs that hold one of them, and exact containment over all lines decides. An edited copy counts if the program, its equal and
   its edited copies stand in at least three repositories. Copies of a program are collapsed before its lines are
   indexed, so a program copied into every repository is indexed once.
3. What is left is judged by its notices and by rules on its token composition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import Durable, durable
from graphloom.llm.sourcetext import FAMILY, PIECES, code_and_literals, decode, opening_and_closing, registered

#: Folders that hold other projects' code (fixed values).
THIRD_PARTY = frozenset("vendor third_party thirdparty third-party node_modules 3p 3rdparty deps bundled contrib external externals bower_components".split())
_GENERATED = re.compile(
    r"^(?:this (?:file|code|is|was)\b.{0,24}?\b)?(?:@generated\b|auto-?\s?generated\b|automatically generated\b|machine[- ](?:written|generated)\b|generated (?:by|with|from)\b|code generated (?:by|from|with)\b|produced by the\b.*\bgenerator)",
    re.I,
)
#: Notices of another origin: taken from elsewhere, an upstream's copy, or fixes that belong elsewhere.
_FOREIGN = re.compile(
    r"\b(?:copied|taken|imported|vendored|derived|adapted|ported|borrowed|extracted|synced|forked)\b(?:\s+\w+){0,3}\s+from\b"
    r"|\b(?:upstream|third[- ]party|vendored)\s+(?:copy|code|file|library|source|version|release|project)\b|^third[- ]party\b"
    r"|\bimported\s+(?:unchanged|verbatim|unmodified|as[- ]is)\b|\bpart of\b.{1,60}\bimported\b"
    r"|\b(?:send|report|submit)\s+(?:all\s+)?(?:fix(?:es)?|patch(?:es)?|bugs?|changes)\s+(?:to|at)\s+(?:that|the\s+original|the\s+upstream|upstream)\b",
    re.I,
)
#: A copyright of a group; it is another's if the group has not the repository's name.
_HOLDER = re.compile(r"(?:\bcopyright\b|\(c\)|\u00a9)[\s\d,(c)\u00a9-]*(?:by\s+)?(?:the\s+)?([\w.-]+)\s+(?:project|authors|contributors|developers|foundation)\b", re.I)
_NUMBER = re.compile(r"(?<![A-Za-z_$])-?(?:0[xX][0-9A-Fa-f]+|\d[\d.]*)")
_ACCESSOR = re.compile(r"^[ \t]*(?:public |protected |private |static |def |func \([^)\n]*\) |function )*(?:[\w<>\[\]*]+ )?[gs]et_?[A-Za-z_]\w*\s*\(", re.M | re.I)
_DEFINED = re.compile(r"^[ \t]*(?:(?:public |protected |private |static |final |async |export )*(?:def|func|function)\b|(?:public |protected |private |static |final )+[\w<>\[\]*]+ \w+\s*\(|\w+\([^()\n]*\)(?:\s*:\s*[\w<>\[\]]+)?\s*\{)", re.M)
KINDS = ("third-party", "generated", "minified", "data")
_COUNTED = re.compile(r"^[ \t]*(?:public |static |def |func \([^)\n]*\) |function )*(?:[\w<>\[\]*]+ )?\w+?_?(\d+)=?\s*(?:\(|$)", re.M)
COPIES = 3
CONTAINED = 0.8
#: Fewer distinct lines than these are no evidence that one text was made from another; equal texts need none.
LEAST_LINES = 4


def is_minified(code: str) -> bool:
    """Dense code: hardly any white space, and lines longer than anyone writes by hand."""
    dense = len(code) - code.count(" ") - code.count("\n") - code.count("\t")
    blank = len(code) - dense
    if dense < 120 or code.lstrip()[:9].lower() in ("<!doctype", "<html>"):
        return False
    lines = [x for x in code.split("\n") if x.strip()]
    return blank < 0.12 * len(code) and dense / len(lines) > 45


def own_kind(path: str, text: str, family: str, code: str, held: int) -> str | None:
    """What a file says of itself by path, notices and composition."""
    if THIRD_PARTY.intersection(path.lower().split("/")[1:-1]):
        return "third-party"
    first, last = opening_and_closing(text, family)
    repo = path.split("/", 1)[0].lower()
    if any(_FOREIGN.search(x) for x in first + last) or any(m[1].lower() not in repo for x in first + last for m in _HOLDER.finditer(x)):
        return "third-party"
    if any(_GENERATED.search(x) for x in first + last):
        return "generated"
    defined, accessors = len(_DEFINED.findall(code)), len(_ACCESSOR.findall(code))
    if accessors >= 8 and accessors >= 0.8 * defined:
        return "generated"
    counted = {int(x) for x in _COUNTED.findall(code) if len(x) < 7}
    if len(counted) >= 8 and counted.issuperset(range(int(0.9 * len(counted)))):
        return "generated"  # members numbered through from 0
    dense = max(1, len(code) - code.count(" ") - code.count("\n") - code.count("\t") + held)
    numbers = sum(map(len, _NUMBER.findall(code)))
    commas = code.count(",")
    if dense > 200 and (held + numbers + commas) / dense > 0.55:
        return "data"
    return "minified" if is_minified(code) else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path, content, language in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not content:
                continue
            family = FAMILY.get(language, "brace")
            text, _ = decode(content)
            code, held = code_and_literals(text, family)
            strings_kept = [x for x in (y.strip() for y in code.split("\n")) if x]
            kind = own_kind(path, text, family, code, held)
            lines = sorted({xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in strings_kept})
            whole = xxhash.xxh3_128_digest("\n".join(strings_kept) + "\0" + str(held) + "\0" + "\0".join(_strings(text, family)))
            out.append((path, path.split("/", 1)[0], kind, whole, sum(map(len, strings_kept)), lines))
        cols = list(zip(*out)) if out else [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "repo", "kind", "program", "size", "lines"])


def _strings(text: str, family: str) -> list[str]:
    return [m.group() for m in PIECES[family].finditer(text) if m.lastgroup == "string"]


def examined_files(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """(path, repo, kind, program, size, lines) of every file with a registered extension and content.

    ``extensions`` (ext, language) is matched exactly, case-sensitively.
    Repeated rows of a path come repeatedly; kind is null for files that look hand-written so far.
    """
    return registered(files, extensions).mapInArrow(_read, "path string, repo string, kind string, program binary, size int, lines array<bigint>")


def _held(examined: Durable, contained: float) -> DataFrame:
    """(program, origin, source, share): programs not third-party so far that hold at least ``contained`` of a third-party program's lines.

    Who holds so many of n lines misses at most n less those, so it holds one of any one more: candidates are the holders of one
    of the rarest, and all lines of both decide. No line is too common to count.
    """
    programs = examined.df.where("size > 0").groupBy("program").agg(F.first("lines").alias("lines"), F.min("path").alias("source"), F.max(F.when(F.col("kind") == "third-party", 1).otherwise(0)).alias("foreign"), F.count_distinct("repo").alias("repos"))
    programs = programs.where(F.size("lines") >= LEAST_LINES).select("program", "lines", "source", F.greatest("foreign", F.when(F.col("repos") >= COPIES, 1).otherwise(0)).alias("foreign"), F.size("lines").alias("n"))
    programs = durable(programs)
    index = durable(programs.df.select("program", "foreign", "n", F.explode("lines").alias("line")))
    counts = index.df.groupBy("line").agg(F.count("*").alias("df"), F.min("foreign").alias("held")).where("held = 0").select("line", "df")
    # lines that only third-party programs hold are the rarest: they are counted, not joined
    ranked = index.df.where("foreign = 1").join(counts, "line", "left").withColumn("rank", F.row_number().over(Window.partitionBy("program").orderBy(F.coalesce("df", F.lit(0)), "line")))
    need = F.ceil(F.col("n") * contained - 1e-9)
    prefix = ranked.where(F.col("df").isNotNull() & (F.col("rank") <= F.col("n") - need + 1)).select(F.col("program").alias("origin"), need.alias("need"), "line")
    pairs = durable(index.df.where("foreign = 0").select("program", "n", "line").join(prefix, "line").where("n >= need").select("program", "origin").distinct(), drop=(index,))
    theirs = programs.df.where("foreign = 1").select(F.col("program").alias("origin"), "source", F.col("lines").alias("of"))
    both = pairs.df.join(theirs, "origin").join(programs.df.where("foreign = 0").select("program", "lines"), "program")
    held = both.select("program", "origin", "source", (F.size(F.array_intersect("lines", "of")) / F.size("of")).alias("share"))
    return held.where(F.col("share") >= contained - 1e-9)


def not_handwritten(files: DataFrame, extensions: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(path, kind): files that are generated, minified, third-party or data; one row per path.

    A path with several different contents is named if any of them is. Empty and null contents are no
    files; ties between kinds go to the one that comes first in ``KINDS``.
    """
    examined = durable(examined_files(files, extensions))
    # a file without code (comments only) has no program text to be copied
    homes = examined.df.where(F.col("size") > 0).select("program", "repo").distinct()
    equal = homes.groupBy("program").agg(F.count("*").alias("repos")).where(F.col("repos") >= COPIES).select("program")
    held = durable(_held(examined, contained)).df
    kin = held.select("origin", "program").union(held.select("origin", F.col("origin").alias("program"))).distinct()
    family = kin.join(homes, "program").groupBy("origin").agg(F.count_distinct("repo").alias("repos")).where(F.col("repos") >= COPIES).select("origin")
    edited = held.join(family, "origin", "left_semi").select("program")
    copies = equal.union(edited).distinct().select("program", F.lit("third-party").alias("copied"))
    kinds = examined.df.select("path", "kind", "program").join(copies, "program", "left").select("path", F.coalesce("copied", "kind").alias("kind")).where("kind IS NOT NULL")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return kinds.groupBy("path").agg(F.min_by("kind", order).alias("kind"))


def vendored_edits(files: DataFrame, extensions: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(path, source, share): files that hold at least ``contained`` of the lines of a third-party file, with other lines than it.

    Lines are distinct code lines, common ones too; share is the exact part of the third-party program's lines that the file holds;
    the best source is named (ties: smaller path).
    """
    examined = durable(examined_files(files, extensions))
    held = _held(examined, contained)
    best = held.groupBy("program").agg(F.min(F.struct((-F.col("share")).alias("s"), "source")).alias("b"))
    return examined.df.select("path", "program").distinct().join(best, "program").select("path", F.col("b.source").alias("source"), F.round(-F.col("b.s"), 6).alias("share"))

"""Sources and sinks: all-string CSV, zipped members, page text and links, atomic publication."""

from __future__ import annotations

import io
import itertools
import json
import posixpath
import unicodedata
import uuid
import zipfile
from collections.abc import Iterable, Sequence
from html.parser import HTMLParser

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROPPED = frozenset(("script", "style", "noscript", "svg", "nav", "footer", "form"))
BLOCKS = frozenset(("h1", "h2", "h3", "h4", "h5", "p", "li", "th", "td"))
TEXT_CAP = 1_500_000
LINK = T.StructType([T.StructField("target", T.StringType()), T.StructField("text", T.StringType())])


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Every column as text; types are cast late and without raising."""
    return spark.read.option("header", True).option("sep", separator).option("inferSchema", False).csv(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str | None]:
    """A table that may be missing or of another shape, and why it was left out, if it was.

    The schema is looked at here, not when the rows are read, so that a bad file costs a
    warning and gives a typed empty table.  Tables that must exist are read plainly, and raise.
    """
    kinds = T.StructType.fromDDL(schema)
    why = None
    try:
        found = spark.read.parquet(path)
        if absent := [f.name for f in kinds if f.name not in found.columns]:
            why = f"{path} lacks {', '.join(absent)}"
        else:
            return found.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in kinds)), None
    except (AnalysisException, Py4JJavaError) as e:
        why = f"{path} can't be read: {str(e).splitlines()[0]}"
    return spark.createDataFrame([], kinds), why


def read_zipped_csv(spark: SparkSession, path: str, member: str, columns: Sequence[str], separator: str = ",") -> DataFrame:
    """A named member of each archive, read where the archive is; unsafe names are refused."""
    if member != posixpath.normpath(member) or member.startswith(("/", "..")) or "\\" in member:
        raise ValueError(f"unsafe member {member}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    for part in pd.read_csv(f, sep=separator, dtype=str, keep_default_na=False, chunksize=50_000):
                        yield part[list(columns)]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


#: Where a page tells its date, best first; the title of pages without one.
DATES = (("property", "article:modified_time"), ("property", "article:published_time"), ("name", "last-modified"), ("name", "date"))
UNTITLED = "Untitled policy page"
#: Elements within which a block may hold another of its kind, and what a new block ends.
BARRIERS = frozenset(("ul", "ol", "table"))
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th")}


class _Page(HTMLParser):
    """Blocks of text in the order they begin, each with all text within it, by the parts of a page that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []  # blocks with their text; barriers without
        self.blocks: list[tuple[str, list[str], frozenset[str]]] = []
        self.roots: dict[str, list] = {}  # kind: tag and depth, 0 once it has ended
        self.links: list[list[str]] = []
        self.titles: list[list[str]] = []
        self.dates: dict[object, str] = {}
        self.skip, self.anchor, self.in_title = 0, False, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = dict(attrs)
        if tag == "a":
            self.anchor = bool(have.get("href"))
            if self.anchor:
                self.links.append([have["href"], ""])
        if tag in DROPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "title":
            self.in_title = True
            self.titles.append([])
        elif tag in ("meta", "time"):
            self._date(tag, have)
        for kind, at in self.roots.items():
            at[1] += at[1] > 0 and at[0] == tag
        for kind in ("main", "article"):
            if tag == kind:
                self.roots.setdefault(kind, [tag, 1])
        if have.get("role") == "main":
            self.roots.setdefault("role", [tag, 1])
        if tag in BARRIERS:
            self.open.append((tag, None))
        elif tag in BLOCKS:
            self._end("p")
            for other in ENDS.get(tag, ()):
                self._end(other)
            held: list[str] = []
            self.open.append((tag, held))
            self.blocks.append((tag, held, frozenset(k for k, at in self.roots.items() if at[1])))

    def _date(self, tag: str, have: dict[str, str | None]) -> None:
        keys = [k for k in DATES if tag == "meta" and have.get(k[0]) == k[1]] + (["time"] if tag == "time" and "datetime" in have else [])
        for k in keys:
            self.dates.setdefault(k, (have.get("content") or have.get("datetime") or "").strip())

    def _end(self, tag: str) -> None:
        """End the innermost open element of a kind, and what is open within it, unless a list or table is between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in BARRIERS and tag not in BARRIERS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchor = False
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip:
            if tag == "title":
                self.in_title = False
            if tag in BLOCKS or tag in BARRIERS:
                self._end(tag)
            for at in self.roots.values():
                at[1] -= at[1] > 0 and at[0] == tag

    def handle_data(self, data: str) -> None:
        if self.anchor:
            self.links[-1][1] += data
        if self.skip:
            return
        if self.in_title:
            self.titles[-1].append(data)
            return
        for _, held in self.open:
            if held is not None:
                held.append(data)

    def text(self) -> str:
        root = next((k for k in ("main", "role", "article") if k in self.roots), None)
        lines: list[str] = []
        for tag, held, within in self.blocks:
            line = squeezed(held)
            if not line or (root and root not in within):
                continue
            line = f"[HEADING {tag[1]}] {line}" if tag[0] == "h" else line
            if not lines or lines[-1] != line:
                lines.append(line)
        return "\n".join(lines)[:TEXT_CAP]


def squeezed(parts: Iterable[str]) -> str:
    return " ".join(" ".join(parts).split())


def parse_page(html: str | None) -> tuple[str, str, str | None, list[tuple[str, str]]]:
    """Title, text by blocks without consecutive repeats, date as told, and the target and text of every link.

    The text is that of the first main element, else of role main, else of the first article,
    else of the body.  A block within a block is in the text of both.  Navigation and the like
    have no text of the page, but they have links.  A page without a title has its first h1.
    """
    p = _Page()
    p.feed(html or "")
    p.close()
    head = next((squeezed(held) for tag, held, _ in p.blocks if tag == "h1"), UNTITLED)
    published = next((p.dates[k] for k in (*DATES, "time") if p.dates.get(k)), None)
    return squeezed(p.titles[0]) if p.titles else head, p.text(), published, [(a, " ".join(b.split())) for a, b in p.links]


def page_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add title, page_text, published and links."""
    texts = ("title", "page_text", "published")
    kind = T.StructType([*(T.StructField(c, T.StringType()) for c in texts), T.StructField("links", T.ArrayType(LINK))])

    @F.pandas_udf(kind)
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(x) for x in s], columns=[*texts, "links"])

    return df.withColumn("__page", parse(html_col)).select("*", "__page.*").drop("__page")


def with_periods(links: DataFrame, target: str = "target", text: str = "text") -> DataFrame:
    """Add fiscal_year and quarter as a link's target or text tells them, else null.

    A year is of four digits, after FY or alone, or of two after FY; a quarter is Q1 to Q4.
    """
    said = F.concat_ws(" ", F.regexp_replace(target, "%20|[_+-]", " "), F.col(text))
    long, short = F.regexp_extract(said, r"(?i)(?:\bFY ?|\b)(20\d\d)(?!\d)", 1), F.regexp_extract(said, r"(?i)\bFY ?(\d\d)(?!\d)", 1)
    year = F.when(long != "", long.cast("int")).when(short != "", short.cast("int") + 2000)
    quarter = F.regexp_extract(said, r"(?i)(?:\b|\d)Q([1-4])(?!\d)", 1)
    return links.withColumns({"fiscal_year": year, "quarter": F.when(quarter != "", quarter.cast("int"))})


# --- sinks ------------------------------------------------------------------------------


def publish(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new generation and swing the pointer to it; readers never see half of one."""
    name = f"gen-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(f"{root}/{name}")
    write_json(df.sparkSession, f"{root}/current.json", {"generation": name})
    return f"{root}/{name}"


def current(spark: SparkSession, root: str) -> DataFrame:
    pointer = spark.read.text(f"{root}/current.json", wholetext=True).first()
    return spark.read.parquet(f"{root}/{json.loads(pointer['value'])['generation']}")


def write_json(spark: SparkSession, path: str, value) -> None:
    write_bytes(spark, path, json.dumps(value, sort_keys=True).encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in any file system that Spark knows: written beside its place, then renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place = place.getFileSystem(conf).makeQualified(place)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
    out = place.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(content))
        out.hsync()
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, place, over)


def upsert(records: Iterable[dict], new: Iterable[dict], keys: Sequence[str]) -> list[dict]:
    """A ledger's records with the new ones in place of those of equal keys, by key."""
    by = {tuple(r[k] for k in keys): r for r in (*records, *new)}
    return [by[k] for k in sorted(by, key=str)]


def header_names(raw: Sequence[str]) -> list[str]:
    """Column names of a header: lower-case words joined by underscores, all different.

    A name that an earlier column has gets the least number from 2 on that makes it free.
    """
    taken: dict[str, None] = {}
    for title in raw:
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in unicodedata.normalize("NFKC", title).casefold()).split()
        name = "_".join(words) if words else "unnamed_column"
        free = itertools.chain([name], (f"{name}_{k}" for k in itertools.count(2)))
        taken[next(x for x in free if x not in taken)] = None
    return list(taken)

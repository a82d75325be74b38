"""Readers of text corpora, all as DataFrames. Gzip is read by name; (file, line_no) is a row's place.

Sentence tables have doc_id, id, text and words.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setphrase.functions import tokens as T

Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def text_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file, line_no from 1, line). Numbering needs a file in one row: split larger files first."""
    whole = spark.read.text(_paths(paths), wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    parts = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n", -1)
    rows = whole.select("file", F.posexplode(parts).alias("i", "line"), F.size(parts).alias("n"))
    # a final line feed ends the last line
    return rows.where("not (i = n - 1 and line = '')").select("file", (F.col("i") + 1).alias("line_no"), "line")


def delimited(spark: SparkSession, paths: Paths, sep: str = "\t", file_has_header: bool = True, headers: Sequence[str] | None = None, skip_invalid_lines: bool = False) -> DataFrame:
    """Unquoted columns of strings with (file, line_no). Given headers win over the file's; rows of another width are skipped or an error."""
    if not file_has_header and headers is None:
        raise ValueError("a file without a header needs headers")
    lines = text_lines(spark, paths)
    if headers is None:
        first = spark.read.text(_paths(paths)).first()
        headers = first["value"].split(sep) if first else []
    if file_has_header:
        lines = lines.where("line_no > 1")
    width = len(headers)
    row = F.split("line", re.escape(sep), -1) if width > 1 else F.array("line")
    rows = lines.select("file", "line_no", row.alias("row"))
    if skip_invalid_lines:
        rows = rows.where(F.size("row") == width)
    else:
        message = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(f": other than {width} columns"))
        rows = rows.withColumn("row", F.when(F.size("row") == width, F.col("row")).otherwise(F.raise_error(message).cast("array<string>")))
    return rows.select("file", "line_no", *[F.col("row")[i].alias(h) for i, h in enumerate(headers)])


def make_reader(**options) -> Callable[[SparkSession, Paths], DataFrame]:
    return lambda spark, paths: delimited(spark, paths, **options)


def corpus(spark: SparkSession, paths: Paths, text_field: str, doc_id_field: str | None = None, tokenize: Callable[[str], Column] = T.words, **options) -> DataFrame:
    """(doc_id, tokens, metadata) of delimited files; without an id field a document is called file:line."""
    rows = delimited(spark, paths, **options)
    doc_id = F.col(doc_id_field) if doc_id_field else F.concat_ws(":", "file", F.col("line_no").cast("string"))
    rest = [c for c in rows.columns if c not in ("file", "line_no", text_field, doc_id_field)]
    meta = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]) if rest else F.create_map().cast("map<string,string>")
    return rows.select(doc_id.alias("doc_id"), tokenize(text_field).alias("tokens"), meta.alias("metadata"))


def doc_reader(spark: SparkSession, paths: Paths, id_field: str, text_field: str, ignorecase: bool = False, include_boundaries: bool = False, remove_punctuation: bool = False, tokenize: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """``corpus`` with words split by blanks unless ``tokenize`` says otherwise, in small letters, between marks and without punctuation if asked.

    Without punctuation, tokens lose the marks at their edges and those that are nothing else go.
    """

    def tokens(text: str) -> Column:
        col = F.lower(F.col(text)) if ignorecase else F.col(text)
        made = tokenize(col) if tokenize else F.filter(F.split(col, r"\s+"), lambda t: t != "")
        if remove_punctuation:
            bare = F.transform(made, lambda t: F.regexp_replace(t, f"^[{T.PUNCT}]+|[{T.PUNCT}]+$", ""))
            made = F.filter(bare, lambda t: t != "")
        return bounded_words(made, "" if include_boundaries else None)

    return corpus(spark, paths, text_field, id_field, tokens, **options)


def bounded_words(words: Column, name: str | None) -> Column:
    """Words between <NAME_START> and <NAME_END>; an empty name gives <START> and <END>, None no marks."""
    if name is None:
        return words
    mark = f"{name}_" if name else ""
    return F.concat(F.array(F.lit(f"<{mark}START>")), words, F.array(F.lit(f"<{mark}END>")))


def split_words(text: str | Column, sep: str = r"[^\p{L}\p{N}_]+", lower: bool = False) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text) if lower else text, sep, -1), lambda w: w != "")


def _fields(spark: SparkSession, paths: Paths, widths: Sequence[int], strict: bool = False) -> DataFrame:
    """(doc_id, id, text): the first, second and last field of tab-separated lines of the given widths; others are skipped or an error."""
    row = F.split(F.trim("value"), "\t", -1)
    rows = spark.read.text(_paths(paths)).select(row.alias("r"))
    known = F.size("r").isin(list(widths))
    if strict:
        rows = rows.withColumn("r", F.when(known, F.col("r")).otherwise(F.raise_error(F.lit("unexpected number of columns")).cast("array<string>")))
    else:
        rows = rows.where(known)
    return rows.select(F.col("r")[0].alias("doc_id"), F.col("r")[1].alias("id"), F.element_at("r", -1).alias("text"))


def resolutions(spark: SparkSession, paths: Paths, ignorecase: bool = False, include_boundaries: bool = False) -> DataFrame:
    return _fields(spark, paths, (3, 4)).withColumn("words", bounded_words(split_words("text", lower=ignorecase), "" if include_boundaries else None))


def notarial(spark: SparkSession, paths: Paths, word_sep: str = r"[^\p{L}\p{N}_]+", lower: bool = False) -> DataFrame:
    rows = _fields(spark, paths, (3,))
    text = F.lower("text") if lower else F.col("text")
    return rows.withColumn("text", text).withColumn("words", split_words("text", word_sep))


def voc_paragraphs(spark: SparkSession, paths: Paths, add_boundaries: bool = False) -> DataFrame:
    """Words between white space, without the marks at their edges."""
    other = r"[^\p{L}\p{N}_]"
    bare = F.regexp_replace("text", f"{other}+$", "")
    return _fields(spark, paths, (3,)).withColumn("words", bounded_words(split_words(bare, rf"{other}*\s+{other}*"), "PARA" if add_boundaries else None))


def newspapers(spark: SparkSession, paths: Paths, lowercase: bool = False) -> DataFrame:
    return _fields(spark, paths, (3, 4), strict=True).withColumn("words", split_words("text", lower=lowercase))


def sentence_rows(docs: DataFrame, id_col: str, text_col: str, infix: str = "-", lower: bool = False, marks: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, text, words) of each sentence; ids are numbered from 1."""
    at = docs.select(*keep, F.col(id_col).alias("_id"), F.posexplode(T.sentences(text_col)).alias("_i", "text"))
    text = F.lower("text") if lower else F.col("text")
    made = at.select(*keep, F.concat(F.col("_id").cast("string"), F.lit(infix), (F.col("_i") + 1).cast("string")).alias("id"), text.alias("text"))
    return made.withColumn("words", bounded_words(split_words("text", lower=lower), marks))


def novels(spark: SparkSession, paths: Paths) -> DataFrame:
    rows = _fields(spark, paths, (3,)).withColumnRenamed("id", "para_id")
    return sentence_rows(rows, "para_id", "text", "-sent-", keep=("doc_id", "para_id"))


def articles(spark: SparkSession, paths: Paths) -> DataFrame:
    """JSON lines."""
    return spark.read.json(_paths(paths))


def wiki(spark: SparkSession, paths: Paths) -> DataFrame:
    return sentence_rows(articles(spark, paths), "id", "text", lower=True, marks="SENT")


def reviews(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.csv(_paths(paths), sep="\t", header=True)


def review_sentences(spark: SparkSession, paths: Paths) -> DataFrame:
    rows = sentence_rows(reviews(spark, paths), "review_id", "review_text")
    return rows.withColumn("words", split_words("text", lower=True))


def police_ordinances(spark: SparkSession, paths: Paths) -> DataFrame:
    rows = spark.read.csv(_paths(paths), sep="\t").select(F.concat_ws("-", "_c0", "_c1").alias("id"), F.col("_c2").alias("text"))
    return rows.withColumn("words", bounded_words(split_words("text"), "PARA"))


def transcribed(xml: bytes) -> list[str]:
    """Paragraphs of a charter's <transcriptie>."""
    try:
        found = ElementTree.fromstring(xml).find(".//transcriptie")
    except ElementTree.ParseError:
        found = None
    inner = "".join(found.itertext()) if found is not None else ""
    paras = re.findall(r"<p\b[^>]*>(.*?)</p>", inner, re.S) or [inner]
    text = "\n".join(re.sub(r"{.*?}", "", re.sub(r"<[^>]+>", "", p)) for p in paras)
    return text.split("\n")


def charters(spark: SparkSession, paths: Paths) -> DataFrame:
    """Paragraphs of the XML files in ZIP archives: the text of <transcriptie>, read as markup itself, without what stands in braces.

    An archive is read by one task, a file of it at a time. Files that aren't well-formed XML, or
    have no <transcriptie>, give one empty paragraph.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".xml") and not n.startswith("__MACOSX")):
                        texts = transcribed(z.read(name))
                        yield pd.DataFrame([(name, f"{name}-{i}", text) for i, text in enumerate(texts, 1)], columns=["doc_id", "para_id", "text"])

    files = spark.read.format("binaryFile").load(_paths(paths)).select("content")
    return files.mapInPandas(run, "doc_id string, para_id string, text string").withColumn("words", split_words("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(file, para_no, text) of (file, line_no, line): a blank line closes a paragraph, even an empty one; what follows the last is one if it has lines."""
    before = F.coalesce(F.sum((F.col("line") == "").cast("int")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("para_no", before)
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"] != ""), lambda x: x["line"]), " ")
    return numbered.groupBy("file", "para_no").agg(F.trim(text).alias("text"))


def merged_paragraphs(paras: DataFrame, doc_col: str = "doc_id", order_col: str = "ord") -> DataFrame:
    """(doc_id, text, tokens) of a document's paragraphs (text, tokens) in their order."""
    rows = F.array_sort(F.collect_list(F.struct(order_col, "text", "tokens")))
    made = paras.groupBy(doc_col).agg(rows.alias("r"))
    return made.select(doc_col, F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"), F.flatten(F.transform("r", lambda x: x["tokens"])).alias("tokens"))


def normalised_corpus(docs: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A source with a chain of steps on its documents."""
    for step in steps:
        docs = docs.transform(step)
    return docs


def facsimile_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(facs, line_id, line_text) of lines such as "#facs_12_r1l3 text"; other lines are dropped."""
    # fixed value: the lines' format
    pattern = r"^#facs_(\d+)_(\w+) +(.*)"
    rows = spark.read.text(_paths(paths)).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select(part(1).cast("int").alias("facs"), part(2).alias("line_id"), part(3).alias("line_text"))


def aligned_to_scans(text: DataFrame, scans: DataFrame) -> DataFrame:
    """Text lines (facs, line_id, line_text) with the scan lines (facs, line_id, scan_id, region_id, line_no, text) they belong to.

    Scan lines without text hold no line of the text: within a region the number of such lines
    before a line shifts it (``shift``).
    """
    empty = F.sum(F.col("text").isNull().cast("int")).over(Window.partitionBy("scan_id", "region_id").orderBy("line_no"))
    return text.join(scans.withColumn("shift", empty), ["facs", "line_id"])


def regions(aligned: DataFrame) -> DataFrame:
    """(scan_id, region_id, lines, continuous): the text's lines by region, and whether their numbers have no gap but for empty lines."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line_id", "line_text")))
    gap = F.max(F.col("line_no") - F.col("shift")) - F.min(F.col("line_no") - F.col("shift")) + 1
    return aligned.groupBy("scan_id", "region_id").agg(rows.alias("lines"), (gap == F.count("*")).alias("continuous"))


def scan_document(text_id: str, found: DataFrame) -> DataFrame:
    """(text_id, scan_ids, json) of a text's regions."""
    made = found.groupBy().agg(F.array_sort(F.collect_set("scan_id")).alias("scan_ids"), F.array_sort(F.collect_list(F.struct("scan_id", "region_id", "lines"))).alias("regions"))
    return made.select(F.lit(text_id).alias("text_id"), "scan_ids", F.to_json(F.struct(F.lit(text_id).alias("text_id"), "scan_ids", "regions")).alias("json"))


def write_bigrams(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Catalogue:
    """Corpora by name, each a reader and its paths; registered as views on demand."""

    def __init__(self, spark: SparkSession, corpora: Mapping[str, Callable[[SparkSession], DataFrame]]):
        self.spark, self.corpora = spark, dict(corpora)

    def __getitem__(self, name: str) -> DataFrame:
        return self.corpora[name](self.spark)

    def register(self) -> None:
        for name in self.corpora:
            self[name].createOrReplaceTempView(name)

    def every(self) -> DataFrame:
        """(corpus, id, words) of all corpora."""
        made = None
        for name in sorted(self.corpora):
            df = self[name].select(F.lit(name).alias("corpus"), F.col("id").cast("string").alias("id"), "words")
            made = df if made is None else made.unionByName(df)
        if made is None:
            raise ValueError("no corpora")
        return made


def kept(df: DataFrame) -> DataFrame:
    """A corpus that several passes read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

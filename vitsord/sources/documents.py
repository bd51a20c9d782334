"""Documents from files: front matter, HTML, title fallback, and chunks by heading and paragraph."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words to which paragraphs are packed; a longer paragraph stays whole.
MAX_WORDS = 160
# File endings read, HTML elements whose content does not count, and elements that end a line.
ENDINGS = ("md", "markdown", "txt", "html", "htm")
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "button"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "br", "blockquote", "dl", "dt", "dd"}


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of the keys between two --- lines at the start, the rest of the text). Keys are lower-cased, the last of equal ones wins."""
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    body = F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']|[\"']$", "").alias("v")))
    # of equal keys only the last pair is kept, whatever the session does with duplicates
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last), body


class _Markdown(HTMLParser):
    """Text of a page as Markdown; an unclosed skipped element hides the rest."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.hidden = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif not self.hidden:
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "1234":
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("\n- ")
            elif tag in BLOCKS:
                self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif not self.hidden and (tag in BLOCKS or len(tag) == 2 and tag[0] == "h" and tag[1] in "1234"):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.out.append(data)


@F.pandas_udf(T.StringType())
def text_of(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8 text; what is none becomes the replacement character (the built-in decoding fails on it)."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8-sig", "replace"))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def html_to_markdown(pages: pd.Series) -> pd.DataFrame:
    """Title and text of HTML pages; there is no built-in HTML parser. White space is left to ``tidy``."""
    titles, bodies = [], []
    for page in pages:
        parser = _Markdown()
        parser.feed(page or "")
        parser.close()
        titles.append("".join(parser.title).strip())
        bodies.append("".join(parser.out))
    return pd.DataFrame({"title": titles, "body": bodies})


def tidy(text: Column) -> Column:
    """Runs of spaces as one, no spaces at line ends, at most one blank line."""
    text = F.regexp_replace(text, r"[ \t\x{a0}]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, agency, url, text, meta) of all documents below ``path``; files with other endings are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    raw = files.select(name.alias("doc_id"), ending.alias("ending"), text_of("content").alias("raw")).where(F.col("ending").isin(*ENDINGS))
    page = raw.where(F.col("ending").isin("html", "htm")).withColumn("page", html_to_markdown("raw"))
    pages = page.select("doc_id", F.col("page.title").alias("found"), tidy(F.col("page.body")).alias("text"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("meta"))
    meta, body = front_matter(F.col("raw"))
    plain = raw.where(~F.col("ending").isin("html", "htm")).select("doc_id", F.lit("").alias("found"), body.alias("text"), meta.alias("meta"))
    every = plain.unionByName(pages)
    get = lambda k: F.try_element_at("meta", F.lit(k))
    heading = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#+\s*(.+)$", 1)), F.lit(""))
    title = F.coalesce(F.nullif(get("title"), F.lit("")), F.nullif(F.col("found"), F.lit("")), heading, F.initcap(F.replace("doc_id", F.lit("-"), F.lit(" "))))
    return every.select("doc_id", title.alias("title"), F.coalesce(get("agency"), F.lit("")).alias("agency"), F.coalesce(get("url"), F.lit("")).alias("url"), "text", "meta")


def chunk_documents(documents: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, title, agency, url, text) -> chunks (chunk_id, doc_id, title, agency, url, section, text), all by higher-order functions.

    A heading line begins a section; blank lines part paragraphs; paragraphs of a section are packed while they stay within
    ``max_words``, and never split. Text before the first heading has the title as its section; a heading without text makes no chunk.
    """
    text = F.concat(F.lit("\n"), F.regexp_replace("text", r"\r\n?", "\n"))
    sections = F.split(text, r"\n(?=#{1,6}\s)", -1)
    lines = documents.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "agency", "url", F.posexplode(sections).alias("section_no", "body"))
    heading = F.trim(F.regexp_extract("body", r"^#{1,6}\s+([^\n]*)", 1))
    rest = F.when(F.col("body").rlike(r"^#{1,6}\s"), F.regexp_replace("body", r"^[^\n]*\n?", "")).otherwise(F.col("body"))
    parts = F.filter(F.transform(F.split(rest, r"\n[^\S\n]*\n\s*", -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    lines = lines.select("doc_id", "title", "agency", "url", "section_no", F.when(F.col("section_no") == 0, F.col("title")).otherwise(heading).alias("section"), parts.alias("parts"))
    words = lambda p: F.size(F.regexp_extract_all(p, F.lit(r"(?U)\S+"), F.lit(0)))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("pack"), F.lit(0).alias("n"))

    def add(state: Column, p: Column) -> Column:
        full = (state["n"] > 0) & (state["n"] + words(p) > max_words)
        begun = F.struct(F.array_append(state["done"], state["pack"]).alias("done"), p.alias("pack"), words(p).alias("n"))
        more = F.struct(state["done"].alias("done"), F.when(state["n"] == 0, p).otherwise(F.concat(state["pack"], F.lit("\n\n"), p)).alias("pack"), (state["n"] + words(p)).alias("n"))
        return F.when(full, begun).otherwise(more)

    packs = F.aggregate("parts", empty, add, lambda s: F.when(s["n"] > 0, F.array_append(s["done"], s["pack"])).otherwise(s["done"]))
    made = lines.select("doc_id", "title", "agency", "url", "section_no", "section", packs.alias("packs"))
    before = F.array_sort(F.collect_list(F.struct("section_no", "section", "packs")))
    per_doc = made.groupBy("doc_id", "title", "agency", "url").agg(before.alias("sections"))
    flat = F.flatten(F.transform("sections", lambda s: F.transform(s["packs"], lambda p: F.struct(s["section"].alias("section"), p.alias("text")))))
    out = per_doc.select("doc_id", "title", "agency", "url", F.posexplode(flat).alias("i", "c"))
    return out.select(F.concat_ws("#", "doc_id", F.col("i").cast("string")).alias("chunk_id"), "doc_id", "title", "agency", "url", F.col("c.section").alias("section"), F.col("c.text").alias("text"))

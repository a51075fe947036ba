"""Registry of the document-engine queries and their oracle SQL."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import document, encodings, render, textops
from pagewright.operators import assembly, layout
from pagewright.sources import compound, files, ooxml, pdf

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _supplier_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of each nation as a sheet: a header row, then key, name and a note that needs quoting."""
    by = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").withColumn("row", F.row_number().over(by))
    note = F.concat(F.lit('a "b", '), F.col("s_suppkey").cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("col"), x.alias("text")) for c, x in enumerate((F.col("s_suppkey").cast("string"), F.col("s_name"), note))])
    body = rows.select("s_nationkey", "row", F.inline(cells))
    head = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(x).alias("text")) for c, x in enumerate(("key", "name", "note"))])
    return render.dense(body.unionByName(rows.where("row = 1").select("s_nationkey", F.lit(0).alias("row"), F.inline(head))), ["s_nationkey"])


@query("""select s_nationkey, count(*) + 1 as rows, 3 as cols, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || s_suppkey || ' | ' || s_name || ' | a "b", ' || s_suppkey || ' |', chr(10) order by s_suppkey) as markdown
from supplier group by s_nationkey""")
def sheet_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse cells to dense grids to Markdown."""
    return _supplier_grids(spark, sf_dir).select("s_nationkey", "rows", "cols", render.markdown(F.col("grid")).alias("markdown"))


@query("""select s_nationkey, 'key' || chr(9) || 'name' || chr(9) || 'note' || chr(10)
  || string_agg(s_suppkey || chr(9) || s_name || chr(9) || 'a "b", ' || s_suppkey, chr(10) order by s_suppkey) as tsv from supplier group by s_nationkey""")
def sheet_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13."""
    return _supplier_grids(spark, sf_dir).select("s_nationkey", render.tsv(F.col("grid")).alias("tsv"))


@query("""select s_nationkey, 'key,name,note' || chr(10)
  || string_agg(s_suppkey || ',' || s_name || ',"a ""b"", ' || s_suppkey || '"', chr(10) order by s_suppkey) as csv from supplier group by s_nationkey""")
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7."""
    return _supplier_grids(spark, sf_dir).select("s_nationkey", render.csv(F.col("grid")).alias("csv"))


@query("""with n as (select p_partkey, p_partkey % 18278 + 1 as number from part)
select p_partkey, number, case when number <= 26 then chr((64 + number)::int)
  when number <= 702 then chr((65 + (number - 27) // 26)::int) || chr((65 + (number - 27) % 26)::int)
  else chr((65 + (number - 703) // 676)::int) || chr((65 + (number - 703) // 26 % 26)::int) || chr((65 + (number - 703) % 26)::int) end as letters,
  number as back from n""")
def a1_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column numbers to letters and back."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 18278 + 1).alias("number"))
    parts = parts.withColumn("letters", textops.column_to_letters(F.col("number")))
    return parts.withColumn("back", textops.letters_to_column(F.col("letters")))


_MD = """(select doc_id, '# ' || source || chr(10) || text || chr(10) || '## ' || lang || chr(10) || '```' || lang || chr(10) || source || chr(10) || '```' || chr(10)
  || '[' || source || '](u/' || doc_id || ') ![' || lang || '](i/' || doc_id || ')' as md from documents)"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with headings, a fence, a link and an image composed around its text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    id_ = F.col("doc_id").cast("string")
    parts = [F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n## "), "lang", F.lit("\n```"), "lang", F.lit("\n"), "source", F.lit("\n```\n["), "source", F.lit("](u/"), id_, F.lit(") !["), "lang", F.lit("](i/"), id_, F.lit(")")]
    return docs.select("doc_id", F.concat(*parts).alias("md"))


@query(f"""select doc_id, length(regexp_extract(h, '^(#+)', 1)) as level, regexp_extract(h, '^#+\\s+(.+)$', 1) as title
from (select doc_id, unnest(regexp_extract_all(md, '(?m)^#{{1,6}}\\s+.+$')) as h from {_MD})""")
def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4."""
    return _markdown(spark, sf_dir).select("doc_id", F.inline(textops.headings(F.col("md")))).withColumnRenamed("text", "title")


@query(f"""select doc_id, unnest(regexp_extract_all(md, '(?s)```(\\w*)\\n(.*?)```', 1)) as lang, unnest(regexp_extract_all(md, '(?s)```(\\w*)\\n(.*?)```', 2)) as code from {_MD}""")
def md_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    return _markdown(spark, sf_dir).select("doc_id", F.inline(textops.code_blocks(F.col("md"))))


@query(f"""select doc_id, unnest(regexp_extract_all(m, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1)) as text, unnest(regexp_extract_all(m, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2)) as url
from (select doc_id, regexp_replace(md, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g') as m from {_MD})""")
def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6."""
    return _markdown(spark, sf_dir).select("doc_id", F.inline(textops.links(F.col("md"))).alias("text", "url"))


@query(f"""select doc_id, unnest(regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1)) as alt, unnest(regexp_extract_all(md, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) as url from {_MD}""")
def md_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    return _markdown(spark, sf_dir).select("doc_id", F.inline(textops.images(F.col("md"))).alias("alt", "url"))


_PLAIN = "md"
for _p, _r in (
    ("(?s)```.*?```", ""), (r"`[^`]+`", ""), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), ("__([^_]+)__", r"\1"), ("_([^_]+)_", r"\1"), (r"(?m)^[-*_]{3,}$", ""), (r"\n{3,}", r"\n\n"), (r"^\s+|\s+$", ""),
):
    _by = "chr(10) || chr(10)" if _r == r"\n\n" else f"'{_r}'"
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', {_by}, 'g')"


@query(f"select doc_id, {_PLAIN} as plain from {_MD}")
def md_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8."""
    return _markdown(spark, sf_dir).select("doc_id", textops.plain_text(F.col("md")).alias("plain"))


@query(r"""select doc_id, regexp_replace(regexp_replace(text, '([,.!?;:])', '  \1', 'g'), '\s+([,.!?;:)\]}])', '\1', 'g') as clean
from documents""")
def punctuation_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks put before punctuation go again."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", textops.punctuation_spacing(F.regexp_replace("text", "([,.!?;:])", "  $1")).alias("clean"))


@query("""select doc_id, replace(text, ' ', chr(9)) as layout, replace(text, ' ', chr(10)) as word
from documents""")
def control_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters put between words go, or become line feeds."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", textops.layout_clean(F.translate("text", " ", "\t")).alias("layout"),
        textops.doc_clean(F.concat(F.lit("\x00\x01"), F.translate("text", " ", "\x0b"))).alias("word"),
    )


@query("""select doc_id, i as line_no, line from (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as i
  from (select doc_id, regexp_replace(text, chr(10) || '$', '') as t from documents where text <> ''))""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, their ends written in four ways."""
    ends = F.element_at(F.array(*[F.lit(x) for x in ("\n", "\r\n", "\r", "\u2028")]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), ends).alias("text"))
    return docs.select("doc_id", F.posexplode(textops.lines(F.col("text"))).alias("line_no", "line"))


@query("""select p_partkey, ['pdf', 'docx', 'pptx', 'xlsx', 'hwpx', 'doc', 'ppt', 'hwp', 'txt', 'txt'][p_partkey % 10 + 1] as format from part""")
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every kind by their bytes, a broken ZIP and plain text among them."""
    made = [
        pdf.write([[]]), ooxml.write_docx([("", "x")]), ooxml.write_pptx([("a", "b")]), ooxml.write_xlsx({"s": [["x"]]}), ooxml.write_hwpx(["x"]), compound.write_doc(["x"]),
        compound.write({"PowerPoint Document": b"x"}), compound.write_hwp(["x"]), b"PK\x03\x04 broken", b"plain",
    ]
    content = F.element_at(F.array(*[F.lit(bytearray(x)) for x in made]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", files.sniff(content).alias("format"))


def _files(source: DataFrame, key: str, make) -> DataFrame:
    """One generated file a group: doc_id and content."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [int(pdf[key].iloc[0])], "content": [make(pdf)]})

    return source.groupBy(key).applyInPandas(run, "doc_id bigint, content binary")


@query("""select n_regionkey as doc_id, r as "row", c as col, x as text from (
  select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as r, unnest([1, 2]) as c, unnest([n_nationkey::varchar, n_name]) as x from nation)""")
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks written from nation, decoded, shared strings joined."""
    make = lambda p: ooxml.write_xlsx({"nations": [[str(r.n_nationkey), r.n_name] for r in p.sort_values("n_nationkey").itertuples()]})
    made = _files(_table(spark, sf_dir, "nation"), "n_regionkey", make)
    return ooxml.sheet_cells(ooxml.elements(made, "xlsx")).select("doc_id", "row", "col", "text")


@query("""select conv_id as doc_id, row_number() over (partition by conv_id order by turn) - 1 as seq, text, case when role = 'user' then 2 else 0 end as heading_level from conversations""")
def docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, one paragraph a turn, the user's as headings."""
    make = lambda p: ooxml.write_docx([("Heading2" if r.role == "user" else "Body", r.text) for r in p.sort_values("turn").itertuples()])
    made = _files(_table(spark, sf_dir, "conversations").where("conv_id is not null"), "conv_id", make)
    return ooxml.paragraphs(ooxml.elements(made, "docx"))


@query("""select conv_id as doc_id, row_number() over (partition by conv_id order by turn) as slide, role as title, text from conversations""")
def pptx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slide a turn, titled by its role."""
    make = lambda p: ooxml.write_pptx([(r.role, r.text) for r in p.sort_values("turn").itertuples()])
    rows = ooxml.elements(_files(_table(spark, sf_dir, "conversations"), "conv_id", make), "pptx").where("kind = 'shape'")
    title = F.max(F.when(F.col("style") == "title", F.col("text"))).alias("title")
    return rows.groupBy("doc_id", (F.col("part") + 1).alias("slide")).agg(title, F.max(F.when(F.col("style") == "", F.col("text"))).alias("text"))


@query("""select conv_id as doc_id, row_number() over (partition by conv_id order by turn) - 1 as seq, text from conversations""")
def hwpx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in numeric order."""
    make = lambda p: ooxml.write_hwpx(p.sort_values("turn").text.tolist())
    rows = ooxml.elements(_files(_table(spark, sf_dir, "conversations"), "conv_id", make), "hwpx")
    return rows.where("kind = 'paragraph'").select("doc_id", F.col("row").alias("seq"), "text")


@query("""with t as (select conv_id, turn, text, row_number() over (partition by conv_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) order by turn) as k from conversations)
select conv_id as doc_id, string_agg(case when turn % 3 = 0 then '## ' else '' end || text, chr(10) || chr(10) order by turn) as text, 'conversation ' || conv_id as title
from t where k = 1 and trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by conv_id""")
def hwpx_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs go, levels make headings, metadata is read."""

    def make(p: pd.DataFrame) -> bytes:
        rows = p.sort_values("turn")
        twice = [(r.text, 2 if r.turn % 3 == 0 else 0) for r in rows.itertuples()]
        return ooxml.write_hwpx(twice + [(t, 0) for t, _ in twice], {"title": f"conversation {rows.conv_id.iloc[0]}"})

    made = _files(_table(spark, sf_dir, "conversations"), "conv_id", make).withColumn("format", F.lit("hwpx"))
    return assembly.documents(made).selectExpr("doc_id", "doc.text as text", "doc.title as title").where("text <> ''")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text items on a page for each order: integer coordinates."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return li.select(
        (F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey").alias("seq"),
        (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 60).cast("double").alias("y"), F.col("l_returnflag").alias("text"),
    )


_SPANS = "(select l_orderkey % 50 as doc_id, l_orderkey as page, (l_partkey % 100)::double as lo, (l_partkey % 100 + l_suppkey % 20)::double as hi from lineitem)"


@query(f"""select doc_id, page, island, min(lo) as lo, max(hi) as hi from (
  select *, sum(fresh) over (partition by doc_id, page order by lo, hi rows unbounded preceding) as island from (
    select *, case when lo > max(hi) over (partition by doc_id, page order by lo, hi rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from {_SPANS}))
group by doc_id, page, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D8, L5."""
    li = _table(spark, sf_dir, "lineitem")
    lo = F.col("l_partkey") % 100
    spans = li.select((F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page"), lo.cast("double").alias("lo"), (lo + F.col("l_suppkey") % 20).cast("double").alias("hi"))
    return layout.merged_intervals(spans)


@query(f"""select doc_id, page, cluster, avg(v) as center, count(*) as n from (
  select *, sum(fresh) over (partition by doc_id, page order by v) as cluster from (
    select doc_id, page, lo as v, case when lo - lag(lo) over (partition by doc_id, page order by lo) > 4 then 1 else 0 end as fresh from {_SPANS}))
group by doc_id, page, cluster having count(*) >= 2""")
def x_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10."""
    return layout.clusters(_items(spark, sf_dir).select("doc_id", "page", F.col("x").alias("v")))


@query("""with recursive items as (select l_orderkey % 50 as doc_id, l_orderkey as page, l_linenumber, l_partkey, (l_partkey % 100)::double as x, (l_suppkey % 60)::double as y, l_returnflag as text from lineitem),
ys as (select distinct doc_id, page, y from items),
anchors as (select doc_id, page, 0 as line, min(y) as a from ys group by doc_id, page
  union all select s.doc_id, s.page, s.line + 1, s.a from (
    select t.doc_id, t.page, t.line, (select min(y) from ys where ys.doc_id = t.doc_id and ys.page = t.page and ys.y > t.a + 5) as a from anchors t) s where s.a is not null),
placed as (select i.*, n.line, row_number() over (partition by i.doc_id, i.page, i.l_linenumber, i.l_partkey, i.x, i.y, i.text order by n.line desc) as latest
  from (select *, row_number() over () as id from items) i join anchors n on i.doc_id = n.doc_id and i.page = n.page and n.a <= i.y),
own as (select doc_id, page, id, max(line) as line from placed group by doc_id, page, id)
select p.doc_id, p.page, p.line, min(p.y) as y, string_agg(p.text, ' ' order by p.x, p.l_linenumber, p.l_partkey, p.text) as text
from placed p join own o on p.id = o.id and p.line = o.line group by p.doc_id, p.page, p.line""")
def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor fold."""
    return layout.lines(_items(spark, sf_dir))


@query("""select l_orderkey as page, floor(l_partkey % 100 / 25)::int as col, floor(l_suppkey % 60 / 20)::int as "row", count(*) as n
from lineitem group by all""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items between rulings every 25 and 20 points, without tolerance."""
    items = _items(spark, sf_dir).withColumn("text", F.lit("x"))
    pos = F.array(*[F.struct(F.lit("v").alias("orient"), F.lit(float(x)).alias("pos")) for x in (0, 25, 50, 75, 100)], *[F.struct(F.lit("h").alias("orient"), F.lit(float(y)).alias("pos")) for y in (0, 20, 40, 60)])
    rulings = items.select("doc_id", "page").distinct().select("doc_id", "page", F.inline(pos))
    found = layout.grid_cells(rulings, items, tolerance=0.0)
    return found.select("page", "col", "row", F.size(F.split("text", " ")).cast("bigint").alias("n"))


@query("""with b as (select l_orderkey % 50 as doc_id, l_orderkey as page, l_linenumber as seq, l_partkey % 3 as col, l_suppkey % 60 as y from lineitem),
f as (select *, 2 * sum((col is not distinct from 0)::int) over (partition by doc_id, page order by y nulls first, seq nulls first, col nulls first rows unbounded preceding)
  - (col is not distinct from 0)::int as band from b)
select doc_id, page, seq, col, y, row_number() over (partition by doc_id, page order by band, col nulls first, y nulls first, seq nulls first) as place from f""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 on all pages: blocks of equal place and number come by column, and what is still equal are equal rows."""
    li = _table(spark, sf_dir, "lineitem")
    blocks = li.select((F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 3).alias("column"), (F.col("l_suppkey") % 60).alias("y"))
    return layout.reading_order(blocks).withColumnRenamed("column", "col")


@query("""select r_regionkey as doc_id, 0 as seq, 1 as level, r_name as text, 1 as page from region
union all select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey), 2, n_name, 1 from nation""")
def struct_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged file a region, headings for itself and its nations, read by their marked content."""

    def make(p: pd.DataFrame) -> bytes:
        rows = p.sort_values("n_nationkey")
        names = [rows.r_name.iloc[0], *rows.n_name]
        nodes = [b"<</S/%b/Pg 4 0 R/K %d>>" % (b"H2" if i else b"H1", i) for i in range(len(names))]
        kids = b" ".join(b"%d 0 R" % (1001 + i) for i in range(len(names)))
        items = [(x, 72, 100 + 20 * i, i) for i, x in enumerate(names)]  # marked content, not place, gives the order
        return pdf.write([items], extra=[b"<</Type/StructTreeRoot/K[%b]>>" % kids, *nodes], catalog=b"/StructTreeRoot 1000 0 R")

    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    made = _files(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey), "n_regionkey", make)  # region has five rows
    docs = assembly.documents(made.withColumn("format", F.lit("pdf")))
    return docs.select("doc_id", F.posexplode("doc.headings").alias("seq", "h"), F.lit(1).alias("page")).selectExpr("doc_id", "seq", "h.level as level", "h.text as text", "page")


@query("""select conv_id, string_agg(case when role = 'user' then '# ' else '' end || text, chr(10) || chr(10) order by turn) as text
from conversations where trim(text) <> '' group by conv_id""")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with marked headings, empty lines between."""
    level = F.when(F.col("role") == "user", 1).otherwise(0).alias("heading_level")
    docs = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", level))).alias("p"))
    return docs.select("conv_id", render.paragraphs_text(F.col("p")).alias("text")).where("text <> ''")


@query("""with t as (select conv_id, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n, role,
  '# ' || role || case when trim(text) <> '' and text <> role then chr(10) || chr(10) || text else '' end as text from conversations)
select conv_id as doc_id, '# Document' || chr(10) || chr(10)
  || case when n > 1 then '> **문서 정보**' || chr(10) || '> - 포맷: PPTX' || chr(10) || '> - 페이지: ' || n || chr(10) || chr(10) else '' end
  || '## 목차' || chr(10) || chr(10) || string_agg('- ' || role, chr(10) order by i) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || string_agg(case when n > 1 then '## 페이지 ' || i || chr(10) || chr(10) else '' end || text || chr(10), chr(10) order by i) as markdown
from t group by conv_id, n""")
def presentation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as presentations, decoded, assembled and rendered."""
    make = lambda p: ooxml.write_pptx([(r.role, r.text) for r in p.sort_values("turn").itertuples()])
    made = _files(_table(spark, sf_dir, "conversations"), "conv_id", make).withColumn("format", F.lit("pptx"))
    return assembly.documents(made).select("doc_id", document.to_markdown(F.col("doc")).alias("markdown"))


@query("""with g as (select n_regionkey as doc_id, count(*) as n, string_agg(n_nationkey || chr(9) || n_name, chr(10) order by n_nationkey) as tsv from nation group by 1)
select doc_id, '=== nations ===' || chr(10) || tsv || chr(10) as text, 1 as page_count, n::int as rows, 2 as cols, 'nations' as heading from g""")
def workbook_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks to documents with their text, tables and headings."""
    make = lambda p: ooxml.write_xlsx({"nations": [[str(r.n_nationkey), r.n_name] for r in p.sort_values("n_nationkey").itertuples()]})
    made = _files(_table(spark, sf_dir, "nation"), "n_regionkey", make).withColumn("format", F.lit("xlsx"))
    return assembly.documents(made).selectExpr("doc_id", "doc.text as text", "doc.page_count as page_count", "doc.tables[0].rows as rows", "doc.tables[0].cols as cols", "doc.headings[0].text as heading")


@query("""select r_regionkey, '{"metadata":{"filename":"' || r_regionkey || '.txt","format":"txt","page_count":1,"title":"","author":""},"content":{"text":"' || r_name
  || '","headings":[]},"pages":[],"tables":[],"images":[]}' as json from region""")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts as JSON documents."""
    name = F.concat(F.col("r_regionkey").cast("string"), F.lit(".txt"))
    doc = document.document(filename=name, format=F.lit("txt"), text=F.col("r_name"))
    return _table(spark, sf_dir, "region").select("r_regionkey", doc.alias("doc")).select("r_regionkey", document.to_json(F.col("doc")).alias("json"))


@query("""with c as (select s_nationkey, count(*) as n, count(*) filter (s_suppkey % 4 = 0) as full_rows, min(s_suppkey) filter (s_suppkey % 4 = 0) as first_full from supplier group by s_nationkey)
select s_nationkey, n >= 2 and 10 * (2 * full_rows + 1) >= 3 * 4 * n as is_data, case when full_rows > 0 then first_full || ' x' end as first_row from c""")
def data_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns a supplier, two of them filled for every fourth; the last cell is always there."""
    by = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").withColumn("row", F.row_number().over(by)).withColumn("last", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_suppkey"))))
    full = F.col("s_suppkey") % 4 == 0
    texts = [F.when(full, F.col("s_suppkey").cast("string")).otherwise(""), F.when(full, "x").otherwise(" "), F.lit(""), F.lit("")]
    cells = rows.select("s_nationkey", "row", "last", F.inline(F.array(*[F.struct(F.lit(c).alias("col"), t.alias("text")) for c, t in enumerate(texts, 1)])))
    grids = render.dense(cells.withColumn("text", F.when((F.col("last") == 1) & (F.col("col") == 4), "z").otherwise(F.col("text"))).drop("last"), ["s_nationkey"], first=1)
    texts_of = F.filter(document.row_texts(F.col("grid")), lambda t: t.endswith(" x") | t.endswith(" x z"))
    return grids.select("s_nationkey", document.is_data_table(F.col("grid")).alias("is_data"), F.regexp_replace(F.get(texts_of, F.lit(0)), " z$", "").alias("first_row"))


@query("""select n_regionkey as doc_id, (n_nationkey % 3)::int as page, n_name as text, (10 * n_nationkey)::double as x, (700 - 20 * n_nationkey)::double as y from nation""")
def pdf_text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations at positions of pages, written and decoded."""

    def make(p: pd.DataFrame) -> bytes:
        return pdf.write([[(r.n_name, 10 * r.n_nationkey, 700 - 20 * r.n_nationkey) for r in p.itertuples() if r.n_nationkey % 3 == i] for i in range(3)])

    rows = pdf.elements(_files(_table(spark, sf_dir, "nation"), "n_regionkey", make))
    return rows.where("kind = 'text'").select("doc_id", "page", "text", "x", "y")


@query("""select conv_id as doc_id, row_number() over (partition by conv_id order by turn) - 1 as seq, trim(text) as text from conversations where trim(text) <> ''""")
def ppt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as binary presentations, one text record a turn."""

    def make(p: pd.DataFrame) -> bytes:
        texts = [t.encode("utf-16-le") for t in p.sort_values("turn").text]
        return compound.write({"PowerPoint Document": b"".join(struct.pack("<HHI", 0, 4000, len(t)) + t for t in texts)})

    rows = compound.elements(_files(_table(spark, sf_dir, "conversations").where("text is not null"), "conv_id", make), "ppt")
    return rows.where("kind = 'shape'").select("doc_id", F.col("row").alias("seq"), "text")


@query("""select doc_id, text from documents""")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in UTF-8 and UTF-16, with and without a mark, decoded again."""
    text, kind = F.col("text"), F.col("doc_id") % 4
    marked = lambda mark, coding: F.concat(F.unhex(F.lit(mark)), F.encode(text, coding))
    content = F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, marked("EFBBBF", "UTF-8")).when(kind == 2, marked("FFFE", "UTF-16LE")).otherwise(marked("FEFF", "UTF-16BE"))
    return _table(spark, sf_dir, "documents").select("doc_id", encodings.text_of(content).alias("text"))


@query("""select conv_id as doc_id, string_agg(trim(text), chr(10) || chr(10) order by turn) as text from conversations where trim(text) <> '' group by conv_id""")
def doc_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as doc files, a paragraph a turn, read by their piece tables."""
    make = lambda p: compound.write_doc(p.sort_values("turn").text.tolist())
    made = _files(_table(spark, sf_dir, "conversations"), "conv_id", make).withColumn("format", F.lit("doc"))
    return assembly.documents(made).selectExpr("doc_id", "doc.text as text").where("text <> ''")


@query("""select n_regionkey as doc_id, '| key | name | even |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || case when n_nationkey % 2 = 0 then 'yes' else '' end || ' |', chr(10) order by n_nationkey) as markdown,
  'intro' || chr(10) || chr(10) || 'key name even' || chr(10) || chr(10) || string_agg(n_nationkey || ' ' || n_name || case when n_nationkey % 2 = 0 then ' yes' else '' end, chr(10) || chr(10) order by n_nationkey) as text
from nation group by n_regionkey""")
def hwp_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph and a table with empty cells; the rows are paragraphs as well."""

    def make(p: pd.DataFrame) -> bytes:
        rows = [[str(r.n_nationkey), r.n_name, "" if r.n_nationkey % 2 else "yes"] for r in p.sort_values("n_nationkey").itertuples()]
        return compound.write_hwp(["intro"], [[["key", "name", "even"], *rows]])

    made = _files(_table(spark, sf_dir, "nation"), "n_regionkey", make).withColumn("format", F.lit("hwp"))
    return assembly.documents(made).selectExpr("doc_id", "doc.tables[0].markdown as markdown", "doc.text as text")


@query("""with t as (select conv_id, text, row_number() over (partition by conv_id order by turn) as i from conversations where trim(text) <> ''),
s as (select conv_id, trim(text) as text, i, (i - 1) // 11 as slide, (i - 1) % 11 as place from t)
select conv_id as doc_id, slide + 1 as page, max(case when place = 0 and length(text) < 100 then text else '' end) as title, count(*) as n from s group by conv_id, slide""")
def ppt_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of binary presentations dealt to slides."""

    def make(p: pd.DataFrame) -> bytes:
        texts = [t.encode("utf-16-le") for t in p.sort_values("turn").text]
        return compound.write({"PowerPoint Document": b"".join(struct.pack("<HHI", 0, 4000, len(t)) + t for t in texts)})

    made = _files(_table(spark, sf_dir, "conversations"), "conv_id", make)
    texts = compound.elements(made, "ppt").where("kind = 'shape'").select("doc_id", "row", "text")
    own = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("t"))
    slides = own.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("t") - 1).cast("int"), F.lit(compound.SLIDE_TEXTS + 1)), lambda a: F.slice("t", a + 1, compound.SLIDE_TEXTS + 1))).alias("page", "own"))
    first = F.col("own")[0]["text"]
    return slides.select("doc_id", (F.col("page") + 1).cast("bigint").alias("page"), F.when(F.length(first) < compound.TITLE_CHARS, first).otherwise("").alias("title"), F.size("own").cast("bigint").alias("n"))


#: Customers of a nation on pages of two columns of 30.
_COLUMNS = """(select c_nationkey as doc_id, (i - 1) // 60 as page, (i - 1) % 60 as place, c_name, least(60, n - (i - 1) // 60 * 60) as own
  from (select *, row_number() over (partition by c_nationkey order by c_custkey) as i, count(*) over (partition by c_nationkey) as n from customer))"""


@query(f"""with t as {_COLUMNS},
lines as (select doc_id, page, place % 30 as line, max(own) as own, string_agg(c_name, ' ' order by place) as text from t group by all)
select doc_id, (page + 1)::int as page, string_agg(c_name, chr(10) order by place) as text from t where own >= 40 group by doc_id, page
union all select doc_id, (page + 1)::int, string_agg(text, chr(10) order by line) from lines where own < 40 group by doc_id, page""")
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two columns are read column by column, sparse ones line by line."""

    def make(p: pd.DataFrame) -> bytes:
        names = p.sort_values("c_custkey").c_name.tolist()
        pages = [names[a : a + 60] for a in range(0, len(names), 60)]
        return pdf.write([[(x, 72 + 273 * (i // 30), 700 - 20 * (i % 30)) for i, x in enumerate(own)] for own in pages])

    docs = assembly.documents(_files(_table(spark, sf_dir, "customer"), "c_nationkey", make).withColumn("format", F.lit("pdf")))
    return docs.select("doc_id", F.inline("doc.pages")).select("doc_id", "page", "text")


_NATIONS = """select n_regionkey as doc_id, '| key | name | part |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | p' || n_nationkey * 7 || ' |', chr(10) order by n_nationkey) as markdown, (count(*) + 1)::int as rows, 3 as cols from nation group by n_regionkey"""


def _nation_pages(spark: SparkSession, sf_dir: str, across: bool, down: bool) -> DataFrame:
    """A table a region with a header, on a page with rulings, and its tables as they are found."""

    def make(p: pd.DataFrame) -> bytes:
        rows = [("key", "name", "part"), *((str(r.n_nationkey), r.n_name, f"p{r.n_nationkey * 7}") for r in p.sort_values("n_nationkey").itertuples())]
        xs, ys = (100, 203, 306, 409), [700 - 24 * k for k in range(len(rows) + 1)]
        lines = [(xs[0], y, xs[-1], y) for y in ys] if across else []
        lines += [(x, a - 0.5, x, b + 0.5) for x in xs for a, b in zip(ys[1:], ys)] if down else []
        return pdf.write([[(t, xs[c] + 8, ys[r] - 10) for r, row in enumerate(rows) for c, t in enumerate(row)]], rulings=lines)

    docs = assembly.documents(_files(_table(spark, sf_dir, "nation"), "n_regionkey", make).withColumn("format", F.lit("pdf")))
    return docs.select("doc_id", F.inline("doc.tables")).select("doc_id", "markdown", "rows", "cols")


@query(_NATIONS)
def pdf_grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by their rulings."""
    return _nation_pages(spark, sf_dir, True, True)


@query(_NATIONS)
def pdf_text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without rulings, by the projection of their text."""
    return _nation_pages(spark, sf_dir, False, False)


@query("""select (l_orderkey % 50) as doc_id, l_orderkey as page, l_linenumber as seq, l_partkey as part, case when y < 0.08 * 60 then 'header' when y > 0.92 * 60 then 'footer'
  when size > 2 * usual then 'title' when size > 1.3 * usual then 'heading' when l_linenumber % 3 = 0 then 'list' else 'paragraph' end as block_type
from (select *, l_suppkey % 60 as y, l_quantity as size, avg(l_quantity) over (partition by l_orderkey) as usual from lineitem)""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11 over line items as blocks."""
    li = _table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") % 3 == 0, "• entry").otherwise("words")
    blocks = li.select((F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 60).cast("double").alias("y"), F.col("l_quantity").alias("font_size"), F.lit(60.0).alias("height"), text.alias("text"))
    return layout.classify(blocks).select("doc_id", "page", "seq", "part", "block_type")

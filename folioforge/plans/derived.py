"""Inputs of the registered queries: rows derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORPUS = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'base-amend' ELSE 'base' END AS codebook_id,
       concat('corpus/', source, '/', cast(doc_id AS string), '.txt') AS source_path, lang, text FROM documents"""

#: Texts with line ends of both kinds, lone CRs, form feeds, characters of two UTF-16 units, and headers.
TEXTS = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'base-amend' ELSE 'base' END AS codebook_id, concat('corpus/', source, '/', cast(doc_id AS string), '.txt') AS source_path, lang,
       CASE doc_id % 6 WHEN 1 THEN replace(text, '. ', concat('.', chr(13), chr(10))) WHEN 2 THEN replace(text, ' a', chr(13)) WHEN 3 THEN replace(text, ' e', concat(chr(12), '😀'))
       WHEN 4 THEN concat('SECTION: a | b | c', chr(13), chr(10), text) WHEN 5 THEN replace(text, ' ', '😀') ELSE text END AS text FROM documents"""

#: A vector of letter counts, which SQL and Python make alike: the embedding of the search queries.
LETTERS = "aeionrst"

HEADERS = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN concat('PDF_PAGE: ', cast(doc_id AS string))
       WHEN doc_id % 13 = 0 THEN 'SECTION: Code A | Chapter 1'
       WHEN doc_id % 3 = 0 THEN concat('SECTION: Code A Amendments | Item ', cast(doc_id AS string), ' | Target R', cast(100 + doc_id % 400 AS string), ' | Op ', CASE WHEN doc_id % 2 = 0 THEN 'replace_section' ELSE 'append_sentence' END)
       ELSE concat('SECTION: Code A | Chapter ', cast(doc_id % 12 + 1 AS string), ' | Section R', cast(100 + doc_id % 400 AS string), '.', cast(doc_id % 7 AS string), ' | ', source) END AS header FROM documents"""

ITEMS = """SELECT doc_id, concat('(', cast(doc_id + 1 AS string), ') In IRC, Section ', CASE WHEN doc_id % 17 = 0 THEN 'AF' WHEN doc_id % 2 = 0 THEN 'R' ELSE '' END, cast(100 + doc_id % 400 AS string), ', ',
       CASE doc_id % 7 WHEN 0 THEN 'is deleted.' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN concat('is deleted and replaced with "R', cast(100 + doc_id % 400 AS string), ' text".') ELSE 'is deleted and replaced with "R1 text".' END WHEN 2 THEN 'the following sentence is added at the end:'
       WHEN 3 THEN 'a new exception is added:' WHEN 4 THEN 'the following definition is added:' WHEN 5 THEN 'the definition for X is modified by adding the words "a" after the word "b".' ELSE 'see note.' END,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(' ', lang, ' ', source, ' ', repeat('x ', 60)) END) AS item_text FROM documents"""

FILE_NAMES = """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat(lpad(cast(doc_id AS string), 9, '0'), '_R', cast(100 + doc_id % 400 AS string), '_add_exception.txt')
       ELSE concat('Title-', cast(50 + doc_id % 9 AS string), CASE WHEN doc_id % 4 = 0 THEN 'B' ELSE '' END, '_Chapter-', cast(50 + doc_id % 9 AS string), CASE WHEN doc_id % 4 = 0 THEN 'B' ELSE '' END, '-', cast(doc_id % 30 AS string),
       '_Section-', cast(50 + doc_id % 9 AS string), CASE WHEN doc_id % 4 = 0 THEN 'B' ELSE '' END, '-', cast(doc_id % 30 AS string), '-', cast(doc_id % 600 AS string), CASE WHEN doc_id % 6 = 0 THEN '.1' ELSE '' END, '.txt') END AS file_name FROM documents"""

LINES = """SELECT doc_id AS line_no, CASE WHEN doc_id % 50 = 10 THEN concat('CHAPTER ', cast(cast(floor(doc_id / 50.0) AS bigint) + 1 AS string), ' ', source)
       WHEN doc_id % 7 = 3 THEN concat('R', cast(100 + doc_id % 800 AS string), CASE WHEN doc_id % 2 = 0 THEN '.1' ELSE '' END, ' Title ', source, '.')
       WHEN doc_id % 37 = 1 THEN 'r303 lower case' WHEN doc_id % 41 = 2 THEN 'SECTION R301 Design' WHEN doc_id % 43 = 4 THEN 'R304 . . . . 12' WHEN doc_id % 47 = 6 THEN 'AB1234 not a section' WHEN doc_id % 53 = 8 THEN ' R305.2.1 Indented . '
       WHEN doc_id % 71 = 5 THEN concat('R', cast(100 + doc_id % 800 AS string)) ELSE concat('body ', lang, ' ', cast(n_chars AS string)) END AS line FROM documents"""

TOKENS = """SELECT p_partkey AS token_id, cast(floor(p_partkey / 200.0) AS bigint) AS page, p_brand AS text,
       cast(p_partkey % 10 AS double) * 60.0 AS x0, cast(p_partkey % 10 AS double) * 60.0 + 5.0 * length(p_brand) AS x1,
       cast(floor((p_partkey % 200) / 10.0) AS double) * 14.0 + cast(p_partkey % 3 AS double) * 0.5 AS top,
       cast(floor((p_partkey % 200) / 10.0) AS double) * 14.0 + cast(p_partkey % 3 AS double) * 0.5 + 10.0 AS bottom, cast(p_size AS double) AS size FROM part"""

PAGE_LINES = """SELECT doc_id, CASE doc_id % 24 WHEN 0 THEN concat('R301.', cast(doc_id % 9 AS string), ' Design . . . . . ', cast(doc_id AS string)) WHEN 1 THEN concat('TABLE OF  CONTENTS ', lang) WHEN 2 THEN 'T A B L E  OF CONTENTS' WHEN 3 THEN 'APPENDIX AB'
       WHEN 4 THEN 'APPENDIX AB Scope; see there.' WHEN 5 THEN 'APPENDIX A ..... A-1' WHEN 6 THEN 'section  Section' WHEN 7 THEN concat('SECTION R', cast(100 + doc_id % 800 AS string)) WHEN 8 THEN concat('R', cast(100 + doc_id % 800 AS string), ' General rule')
       WHEN 9 THEN concat('R', cast(100 + doc_id % 800 AS string), '.1(2) General') WHEN 10 THEN concat('R', cast(100 + doc_id % 800 AS string), ' lower') WHEN 11 THEN 'Chapter 12B Title' WHEN 12 THEN 'Utah amended text' WHEN 13 THEN 'TABLE R301.2(1) Loads, CONTINUED'
       WHEN 14 THEN 'Is it so? Yes' WHEN 15 THEN 'no mark here' WHEN 16 THEN 'page 17' WHEN 17 THEN concat(source, ' ... ... A-12 ') WHEN 18 THEN '' WHEN 19 THEN 'appendix ZZ lower' WHEN 20 THEN concat('RE1001.2.3.4 ', source) WHEN 21 THEN 'Part part' WHEN 22 THEN NULL ELSE concat(lang, ': ', cast(n_chars AS string)) END AS line FROM documents"""

REGISTRY = """SELECT * FROM (VALUES (0, 'base', 'Base code', false, cast(NULL AS string)), (1, 'base-amend', 'Amendments', true, 'base'), (2, 'base-amend-2', 'Later amendments', true, 'base'), (3, 'other', 'Other code', cast(NULL AS boolean), cast(NULL AS string))) AS r(ord, id, label, is_amendment, base_id)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the table it names, without a view in the session."""
    for name in ("documents", "part"):
        if sql.endswith(f"FROM {name}"):
            return spark.sql(sql.removesuffix(name) + "{source}", source=table(spark, sf_dir, name))
    return spark.sql(sql)

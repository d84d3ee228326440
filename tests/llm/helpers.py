import re

import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def rows(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def docs_of(spark, texts, sources=None):
    data = [(k, t, "en", sources[k] if sources else "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(data, DOC_SCHEMA)


def small_sf(spark, tmp_path, texts, **more):
    docs_of(spark, texts, more.get("sources")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


HARD = [None, "", " \n\t ", "one", "a b c d e f g h i j", "x " * 3000, "éè 中文 \U0001f600 end", "a  b\n\nc \n d ", "same text here"] + ["same text here"] * 3

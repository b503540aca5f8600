import hashlib
import re

from passagemill.plans.catalog import QUERIES

ADDED = " call 13800138000 or 913800138000 13800138000,13800138001 id 11010519491231002X."


def masked(text):
    """Brute force: whole runs of digits that are 11 long and begin with 1; 18-character numbers between non-word characters."""
    out = re.sub("[0-9]+", lambda m: "[PHONE]" if len(m[0]) == 11 and m[0][0] == "1" else m[0], text)
    return re.sub(r"\w+", lambda m: "[ID]" if re.fullmatch("[0-9]{17}[0-9Xx]", m[0]) else m[0], out)


def test_every_document_is_masked(spark, tmp_path):
    texts = ["plain", None, "", "card 4111111111111111 end", "13812345678", "13812345678 13912345678,13712345678", "id 110105194912310021", "11010519491231002X 11010519491231002x", "x110105194912310021", "12345678901234567890", "tel:13812345678x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in QUERIES["mask_pii"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(masked(t + ADDED).encode()).hexdigest() for i, t in enumerate(texts)}


def test_given_documents_keep_their_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, r.text and hashlib.md5(masked(r.text + ADDED).encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert sorted((r.doc_id, r.digest) for r in QUERIES["mask_pii"](spark, sf).collect()) == want

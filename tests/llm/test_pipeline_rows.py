import corpus_pipeline
from pyspark.sql import functions as F

from passagemill.sources.scratch import noted

SF = "/root/testdata/sf0.01"


def _stage(spark, rows, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = spark.createDataFrame([(i, t, "en", "made", len(t)) for i, t in rows], docs.schema)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.unionByName(made), SF)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.where("source = 'made'").collect()), key=str)


def test_rows_are_judged_by_their_own_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = "an ordinary line about rivers and the bridges that cross them"
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    toxic = next(r.text for r in docs.orderBy("doc_id").collect() if r.doc_id not in kept)
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    for name, bad in (("toxicity", toxic), ("language_id", "12 34 !!"), ("decontamination", passage)):
        rows = [(None, bad), (None, bad), (None, clean), (-1, bad), (-1, clean)]
        assert _stage(spark, rows, name) == sorted([(None, clean), (-1, clean)], key=str), name


def test_one_row_of_equal_texts_stays(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in ("reed", "moss", "fern"))
    rows = [(None, one), (None, one), (-1, two), (-1, two), (None, two), (-1, three), (-2, three), (None, ""), (None, "")]
    assert _stage(spark, rows, "minhash_near_dedup") == sorted([(None, one), (-1, two), (-2, three), (None, ""), (None, "")], key=str)


def test_near_duplicates_write_no_text_and_keep_one_of_repeated_rows(spark):
    """Rows alike in id and text: one stays, whole; texts are in no table that the stage writes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("reed", "moss"))
    near = one + " and"
    rows = [(None, one, "en", "made-b", 1), (None, one, "en", "made-a", 1)] * 300 + [(-3, two, None, "made-c", 1), (-3, two, "en", "made-c", 2), (-3, near, "en", "made-d", 1), (-3, near, "en", "made-d", 1)]
    rows += [(None, None, "en", "made-e", 0)] * 2
    with noted() as made:
        out = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    assert not [t for t in made if "text" in t.schema.simpleString()]
    got = sorted(tuple(r) for r in out.where("source like 'made-%'").select("source", "doc_id", "n_chars", F.md5("text")).collect())
    assert [(s, i) for s, i, _, _ in got] == [("made-c", -3), ("made-d", -3), ("made-e", None), ("made-e", None)]
    assert got[0][2] == 2
    alone = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows[:600], docs.schema), SF).collect()
    assert [(r.doc_id, r.text, r.source) for r in alone] == [(None, one, "made-a")]


def test_junk_with_letters_goes_whatever_single_rows_say(spark):
    """Junk that names no language goes, also where a single row of junk names one; clean texts stay without a name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = ["zqxj vkqw zzxq jjkv qqzx wxyz kqjv zxqj " * 6, "\u0416\u0449\u044a " * 40, "qqqq xxxx zzzz jjjj " * 12]
    clean = [r.text for r in docs.where("n_chars > 400").orderBy("doc_id").limit(8).collect()]
    rows = [(-i, t, None, "made", len(t)) for i, t in enumerate(junk + clean, 1)] + [(-99, junk[0], "en", "made", 1)]
    out = corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    assert {r.doc_id for r in out.where("source = 'made'").collect()} == {-i for i in range(len(junk) + 1, len(junk) + len(clean) + 1)} | {-99}


def test_texts_in_no_known_language_go_although_short_ones_are_as_far(spark):
    """One-word texts that name a language are as far from all prototypes as whole texts of another one: these go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    other = [
        "Tutti gli esseri umani nascono liberi ed eguali in dignit\u00e0 e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libert\u00e0 enunciate nella presente Dichiarazione",
        "Kaikki ihmiset syntyv\u00e4t vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu j\u00e4rki ja omatunto, ja heid\u00e4n on toimittava toisiaan kohtaan veljeyden hengess\u00e4. Jokainen on oikeutettu kaikkiin t\u00e4ss\u00e4 julistuksessa esitettyihin oikeuksiin ja vapauksiin",
    ]
    clean = [r.text for r in docs.where("n_chars between 1000 and 2000").orderBy("doc_id").limit(12).collect()]
    rows = [(-i, t, None, "made", len(t)) for i, t in enumerate(other + clean, 1)] + [(-99, other[0], "en", "made", 1)]
    out = corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    assert {r.doc_id for r in out.where("source = 'made'").collect()} == {-99, *range(-14, -2)}


def test_texts_in_another_language_than_they_name_go(spark):
    """Texts under a wrong name go, also where 3% have one; the same texts stay without a name, and those of two languages under either one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = docs.where("n_chars between 300 and 3000").orderBy("doc_id").limit(300)
    langs = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    other = langs[((F.array_position(langs, F.col("lang")) + F.col("doc_id") % 3) % 4).cast("int")]
    wrong = texts.withColumns({"lang": other, "source": F.lit("wrong")})
    nameless = texts.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("none")})
    both = "\n".join(docs.where(f"lang = '{x}' and n_chars between 1500 and 2500").orderBy("doc_id").first().text for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, both, x, "mixed", len(both)) for x in ("en", "de")], docs.schema)
    out = corpus_pipeline.keep_known_languages(spark, docs.unionByName(wrong).unionByName(nameless).unionByName(mixed), "/root/testdata/sf0.1")
    kept = F.when(F.col("source").isin("wrong", "none", "mixed"), F.col("source")).otherwise("given")
    n = {r.kept: r.n for r in out.groupBy(kept.alias("kept")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n.get("wrong", 0) <= 12 and n["none"] >= 298 and n["given"] >= 0.999 * docs.count()
    assert n["mixed"] == 2


def test_two_runs_and_lazy_stages(spark):
    """A stage that is read late still has its tables after others ran; the session's batches are as before."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_refused", F.lit(1)).withColumn("score", F.lit("x"))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    late = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    spark.conf.unset(conf)
    before = spark.conf.get(conf)
    one, two = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert spark.conf.get(conf) == before
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert late.columns == docs.columns and 0 < late.count() <= docs.count()

from pyspark.sql import functions as F

from lexispark import cli
from lexispark.functions import text as X
from lexispark.operators import cleaning as C
from lexispark.operators import profiling as P
from lexispark.sources import files


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


def test_white_space_is_unicode(spark):
    assert column(spark, ["a b　c", "a\x1cb", "", "a\x85b c"], X.count_words) == [3, 2, 0, 3]
    assert column(spark, [" a \t b\n", "　x\x1c"], X.normalize_space) == ["a b", "x"]
    assert column(spark, ["", " ", "x"], X.is_blank) == [True, True, False]


def test_nfc_and_html(spark):
    assert column(spark, ["café", "plain", None], X.nfc) == ["café", "plain", None]
    assert column(spark, ["&lt;b&gt;hi&lt;/b&gt; &amp; you", "x&amp;lt;y", "<i>a</i>  b", "a &amp b", None], X.strip_tags) == [" hi  & you", "x&lt;y", " a   b", "a & b", None]


def test_plain_words(spark):
    assert column(spark, ["Don't stop-it, ¿qué?", ""], X.plain_words) == [["dont", "stopit", "¿qué"], []]


def test_truncation_and_ngrams(spark):
    df = spark.createDataFrame([([2, 10, 11, 12, 13, 3],)], "a array<int>")
    assert df.select(X.truncate_keeping_last(F.col("a"), 4)).first()[0] == [2, 10, 11, 3]
    words = spark.createDataFrame([(["a", "b", "c"],), ([],)], "w array<string>")
    assert [r[0] for r in words.select(X.ngrams(F.col("w"), 2)).collect()] == [["a b", "b c"], []]


def pairs(spark, rows):
    return spark.createDataFrame([(i, "train", a, b) for i, (a, b) in enumerate(rows)], "line_no long, split string, src string, tgt string")


def test_each_filter(spark):
    long = lambda n: " ".join(["w"] * n)
    df = pairs(spark, [("", "hola que tal"), ("123 !! ??", "hola que tal"), (long(2), long(3)), (long(3), long(3)), (long(100), long(99)), (long(101), long(99)), (long(3), long(9)), (long(3), long(10))])
    keep = lambda out: sorted(r["line_no"] for r in out.collect())
    assert keep(C.filter_empty(df)) == [1, 2, 3, 4, 5, 6, 7]
    assert keep(C.filter_punctuation_only(df)) == [2, 3, 4, 5, 6, 7]
    assert keep(C.filter_length(df)) == [1, 3, 4, 6, 7]
    assert keep(C.filter_misaligned(df)) == [1, 2, 3, 4, 5, 6]
    assert keep(C.length_mismatches(df)) == [7]


def test_dedup_keeps_the_first(spark):
    out = C.deduplicate(pairs(spark, [("a", "b"), ("a", "c"), ("a", "b")]))
    assert sorted((r["line_no"], r["src"], r["tgt"]) for r in out.collect()) == [(0, "a", "b"), (1, "a", "c")]


def test_accounting_adds_up(spark):
    rows = [("", "hola que tal"), ("1 2 3", "hola que tal"), ("one two", "uno dos tres"), ("a b c", "a b c d e f g h i j k"), ("one two three", "uno dos tres"), ("one  two three ", "uno dos tres"), ("<b>x</b> y z", "café y z")]
    r = C.accounting(pairs(spark, rows)).first().asDict()
    assert (r["original"], r["empty"], r["punctuation_only"], r["length_filtered"], r["misaligned"], r["duplicates"], r["final"]) == (7, 1, 1, 1, 1, 1, 2)
    assert (r["unicode_normalized"], r["html_cleaned"], r["whitespace_normalized"]) == (1, 1, 2)
    assert C.clean(pairs(spark, rows)).count() == 2
    assert C.accounting(pairs(spark, rows).limit(0)).count() == 0


def test_profile(spark):
    df = pairs(spark, [("a b", "c"), ("a b", "d"), ("a b", "c")])
    assert P.duplicate_summary(df).first().asDict() == {"src_dups": 2, "n_pairs": 3, "tgt_dups": 1, "pair_dups": 1}
    assert [tuple(r) for r in P.one_to_many(df).collect()] == [("a b", 2)]
    values = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10, 11)], "v double")
    assert {r["bin"]: r["n"] for r in P.histogram(values, "v", 0, 10, 2).collect()} == {0: 2, 1: 2}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.en").write_text(" one \ntwo\n\nfour\n")
    (tmp_path / "a.es").write_text("uno\ndos\ntres\ncuatro\n")
    df = files.read_parallel(spark, str(tmp_path / "a.en"), str(tmp_path / "a.es"))
    assert sorted(map(tuple, df.collect())) == [(0, "one", "uno"), (1, "two", "dos"), (2, "", "tres"), (3, "four", "cuatro")]
    files.write_parallel(df, str(tmp_path / "o.en"), str(tmp_path / "o.es"))
    again = files.read_parallel(spark, str(tmp_path / "o.en"), str(tmp_path / "o.es"))
    assert sorted(again.collect()) == sorted(df.collect())
    both = files.read_lines(spark, str(tmp_path / "a.en"), str(tmp_path / "a.es"))
    assert [r["text"] for r in both.orderBy("line_no").collect()] == ["one", "two", "", "four", "uno", "dos", "tres", "cuatro"]
    (tmp_path / "b.es").write_text("uno\n")
    try:
        files.read_parallel(spark, str(tmp_path / "a.en"), str(tmp_path / "b.es"))
        raise AssertionError("no error")
    except ValueError:
        pass
    files.write_json(spark, {"a": [1, "é"]}, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")) == {"a": [1, "é"]}
    history = spark.createDataFrame([(1, 2.0, 3.0, 0.1, None, None, None)], files.HISTORY)
    files.write_history(history, str(tmp_path / "h"))
    assert files.read_history(spark, str(tmp_path / "h")).collect() == history.collect()


def test_splits_are_cleaned_each_on_its_own(spark, tmp_path):
    good = ["the first line here", "the first line here", "a b", "another <b>fine</b>  line", "123 !! 4"]
    for split in ("train", "dev"):
        for lang in ("en", "es"):
            (tmp_path / f"{split}.{lang}").write_text("\n".join(good) + "\n")
    for lang in ("en", "es"):
        (tmp_path / f"test.{lang}").write_text("")
    cli.main(["preprocess", "--input", str(tmp_path), "--output", str(tmp_path / "out")], spark)
    stats = files.read_json(spark, str(tmp_path / "out" / "preprocessing_stats.json"))
    assert {k: stats["train"][k] for k in ("original", "duplicates", "length_filtered", "punctuation_only", "html_cleaned", "final")} == {"original": 5, "duplicates": 1, "length_filtered": 1, "punctuation_only": 1, "html_cleaned": 1, "final": 2}
    assert stats["dev"]["duplicates"] == 0 and stats["dev"]["final"] == 3 and stats["config"]["max_ratio"] == 3.0 and "test" not in stats
    both = files.read_parallel(spark, str(tmp_path / "out" / "dev.en"), str(tmp_path / "out" / "dev.es")).orderBy("line_no").collect()
    assert [(r["src"], r["tgt"]) for r in both] == [(x, x) for x in ("the first line here", "the first line here", "another fine line")]
    assert sorted(r["text"] for r in files.read_lines(spark, str(tmp_path / "out" / "train.en")).collect()) == ["another fine line", "the first line here"]


def test_a_pair_in_two_splits_counts_in_both(spark):
    rows = spark.createDataFrame([(1, "a", "one two three", "uno dos tres"), (2, "b", "one two three", "uno dos tres"), (3, "b", "one two three", "uno dos tres")], "line_no long, split string, src string, tgt string")
    assert C.clean(rows).count() == 2 and {r["split"]: r["final"] for r in C.accounting(rows).collect()} == {"a": 1, "b": 1}


def test_lines_are_numbered_through_large_files(spark, tmp_path):
    want = [f"line {i}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(want[:4000]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(want[4000:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r["line_no"]: r["text"] for r in files.read_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == dict(enumerate(want))


def test_percent_longer(spark):
    df = spark.createDataFrame([("en", "a b"), ("en", "a b c d"), ("es", "a b c d e f")], "lang string, text string")
    assert tuple(P.percent_longer(df, "en", "es").first()) == (3.0, 6.0, 100.0)


def test_cut_off_references_of_pages_equal_sql(spark, tmp_path):
    import duckdb

    from lexispark.plans import cleaning

    pages = [(1, "a &amp<b>c</b> &amp; d"), (2, "&copy; &am"), (3, "&amp;quot; &quot;x&quot;&middot;"), (4, "&amp"), (5, "no &amp reference &copy"), (6, ""), (7, "&&amp;&&&amp x;")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(f"select page_id, md5, n from ({cleaning.ORACLE_SQL['clean_html_pages']}) order by 1").fetchall()
    assert sorted(map(tuple, cleaning.QUERIES["clean_html_pages"](spark, str(tmp_path)).collect())) == want

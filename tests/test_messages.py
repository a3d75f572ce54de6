import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import messages as M
from loomspark.schemas import RAW_ITEM, first_column
from loomspark.sources import dumps

COLUMNS = [c.split()[0] for c in RAW_ITEM.split(",")]


def item(**kw):
    base = {"id": "a", "name": "t3_a", "link_id": None, "parent_id": None, "subreddit": "AskX", "author": "me", "title": "t" * 20, "selftext": "s", "body": None, "permalink": None, "distinguished": None, "created_utc": 1.0, "ups": 10.0, "downs": None}
    return tuple((base | kw)[c] for c in COLUMNS)


def table(spark, rows, kind="comment"):
    return M.message_table(spark.createDataFrame(rows, RAW_ITEM), F.lit(kind))


def test_submission_and_comment_shapes(spark):
    s = table(spark, [item(title="Hello", selftext=None, ups=50.0, link_id="wrong")], "submission").first()
    assert (s.link_id, s.parent_id, s.body, s.downs) == ("t3_a", None, "Hello\n", 0.0)
    c = table(spark, [item(body="b", ups=50.0, link_id="t3_z")]).first()
    assert (c.link_id, c.parent_id, c.permalink, c.nlp_top_score, c.is_idea) == ("t3_z", "", "", None, False)


@pytest.mark.parametrize(
    "kw, kept",
    [
        ({}, True), ({"author": "autobot"}, False), ({"author": "AutoBOT"}, True), ({"author": "robotics"}, False), ({"author": None}, True),
        ({"distinguished": "moderator"}, False), ({"distinguished": "admin"}, False), ({"distinguished": "special"}, True),
        ({"ups": 5.0, "body": "x" * 5}, False), ({"ups": 5.0, "body": "x" * 6}, True), ({"ups": None, "body": "é😀" * 13}, True),
        ({"body": "they should just stop" + "x" * 30}, False), ({"body": "They should just stop" + "x" * 30}, True),
        ({"body": "free \r beer for everyone" + "x" * 30}, False), ({"body": "free \n beer for everyone" + "x" * 30}, True), ({"body": None, "ups": 7.0}, True),
    ],
)
def test_filters(spark, kw, kept):
    assert table(spark, [item(**({"body": "y" * 40} | kw))]).count() == kept


def test_flags_and_empty(spark):
    got = [r.cpu_filter_is_idea for r in table(spark, [item(body="A NEW way " + "x" * 40), item(id="b", body="nothing" * 9)]).orderBy("id").collect()]
    assert got == [True, False]
    assert table(spark, []).count() == 0
    clash = spark.createDataFrame([item(body="x" * 100)], RAW_ITEM).withColumn("is_idea", F.lit("clash"))
    assert M.message_table(clash, F.lit("comment")).first().is_idea is False


def test_quality(spark):
    rows = [("", 9), (None, 9), ("calm words", 9), ("!" * 10, 9), ("LOUD", 9), ("costs $20 " + "word " * 120, 8), ("no votes", None)]
    df = spark.createDataFrame(rows, "b string, u int").select(M.quality_score(F.col("b"), F.col("u")).alias("q"))
    assert [r.q for r in df.collect()] == [0, 0, 9, 4.5, 4.5, 12, 0]


def test_names(spark):
    rows = [("AskReddit", "as", "askreddit", "AskReddit"), ("a-B", "a", "a-b", "aB"), ("_x", "_x", "_x", "_x"), ("", "", "_", ""), ("Éa!", "éa", "a", "Éa")]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = df.select("s", X.name_prefix(F.col("s")), X.path_name(F.col("s")), X.dir_name(F.col("s"))).collect()
    assert [tuple(r) for r in got] == rows


def test_scalars(spark):
    df = spark.createDataFrame([("t1_abc_d", -1.5, 'x\\y\t"z"\n', "```json\n{\"a\": 1}\n```")], "p string, x double, t string, j string")
    row = df.select(
        X.second_segment(F.col("p")), X.last_segment(F.col("p")), X.round_to_long(F.col("x")), X.tsv_field(F.col("t")), X.fenced_json(F.col("j")), X.repair_json(F.lit(r'{"a": "b\c"}')),
        X.epoch_text(F.lit("bad")), X.epoch_text(F.lit("86400.9")), X.shorten(F.lit("abc"), 2), X.says_yes(F.lit("oh yes")), X.tsv_field(F.lit(None).cast("string")), X.glob_match(F.lit("My.Biz!"), "*biz?"),
        X.month_tag(F.lit(1704067200.0)),
    ).first()
    assert list(row) == ["abc", "d", -2, 'x\\\\y "z" ', '{"a": 1}', r'{"a": "b\\c"}', None, "1970-01-02 00:00:00", "ab...", True, "\\N", True, "0124"]


def test_dumps(spark, tmp_path):
    import pyarrow as pa

    good = b'{"id":"1","ups":3,"extra":{"x":1}}\n{bad\n[1]\n\n{"id":"2","ups":"x","body":"a\xffb"}\n'
    (tmp_path / "sub").mkdir()
    with pa.CompressedOutputStream(str(tmp_path / "sub/RS_1.zst"), "zstd") as out:
        out.write(good)
    for name in ("RC_2.jsonl", "other.jsonl", "RC_3.txt", "submission_x.jsonl"):
        (tmp_path / name).write_bytes(good)
    base = f"file://{tmp_path}"
    files = dumps.discover(spark, base)
    assert {(r.name, r.kind) for r in files.collect()} == {("RS_1.zst", "submission"), ("RC_2.jsonl", "comment")}
    by_path = {r.name: r.kind for r in dumps.discover(spark, base, "path").collect()}
    assert by_path == {"RS_1.zst": "submission", "RC_2.jsonl": "comment", "other.jsonl": "comment", "submission_x.jsonl": "submission"}
    assert dumps.discover(spark, base, done=files.filter("kind = 'comment'")).count() == 1
    assert [r.name for r in dumps.pick_files(files, only=["RS_1.zst"], without=["RC_2.jsonl"], year="1", not_month="_9").collect()] == ["RS_1.zst"]
    for path in ("sub/RS_1.zst", "RC_2.jsonl"):
        got = dumps.parse_items(dumps.read_lines(spark, f"{base}/{path}", parts=2)).orderBy("id").collect()
        assert [(r.id, r.ups) for r in got][0] == ("1", 3.0)
    assert dumps.read_json(spark, f"{base}/RC_2.jsonl", max_items=1).count() == 1


def test_first_column():
    assert first_column(["x", "text"], ["body", "text"]) == "text"
    with pytest.raises(ValueError):
        first_column([], ["body"])

import pytest
from oracle import compare

from barline.llm import common, quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows, schema=SCHEMA):
    got = quotations.linked(spark.createDataFrame(rows, schema))
    return {(r["conv_id"], r["turn"]): r for r in got.collect()}


THREAD = [
    (1, 0, "user", "Where do the swallows go in winter?\n\nI have asked everyone I know."),
    (1, 1, "assistant", "On Monday someone wrote:\n> Where do the  SWALLOWS go in winter?\n\nThey fly to the south."),
    (1, 2, "user", "> They fly to the south.\n>> Where do the swallows go\n>> in winter?\nAll of them, every year?"),
    (1, 3, "user", "No quote in here, but a > b."),
    (1, 4, "user", "> Something nobody ever said before\nReally."),
    (1, 5, "user", ">> Where do the swallows go in winter?\nStill asking."),
    (2, 0, "user", "> They fly to the south.\nOther conversation."),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, None, ">"),
    (None, 0, "user", "> They fly to the south."),
    (2, None, "user", "> Other conversation."),
]


def test_links_follow_quotes(spark):
    got = linked(spark, THREAD)
    parent = {k: (r["parent_turn"], r["root_turn"], r["depth"]) for k, r in got.items()}
    assert parent[(1, 0)] == (None, 0, 0)
    assert parent[(1, 1)] == (0, 0, 1)
    assert parent[(1, 2)] == (1, 0, 2)
    assert parent[(1, 3)] == (None, 3, 0) and parent[(1, 4)] == (None, 4, 0)
    assert parent[(1, 5)] == (0, 0, 1)
    assert parent[(2, 0)] == (None, 0, 0)
    assert got[(1, 1)]["text"] == "They fly to the south."
    assert got[(1, 2)]["text"] == "All of them, every year?"
    assert got[(1, 3)]["text"] == "No quote in here, but a > b."
    assert got[(2, 1)]["text"] is None and got[(2, 2)]["text"] == "" and got[(2, 3)]["text"] == ""
    assert got[(1, 4)]["n_passages"] == 1 and got[(1, 4)]["n_found"] == 0


def test_deep_threads_and_repeats(spark):
    rows = [(1, 0, "user", "message number zero says this")]
    for k in range(1, 40):
        rows.append((1, k, "user", f"> message number {'zero' if k == 1 else k - 1} says this\nmessage number {k} says this"))
    rows += rows[5:7]
    got = linked(spark, rows)
    for k in range(40):
        assert (got[(1, k)]["root_turn"], got[(1, k)]["depth"]) == (0, k)
    assert quotations.linked(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


def test_clashing_columns_long_texts_and_empty_table(spark):
    long = "\n".join(">" * (k % 50 + 1) + f" words of line {k}" for k in range(5000))
    rows = [(1, 0, "user", "x " * 50_000, 9), (1, 1, "user", long, 9), (1, 2, "user", ">" * 50_000, 9)]
    got = quotations.linked(spark.createDataFrame(rows, SCHEMA + ", depth int")).collect()
    assert len(got) == 3 and {r["depth"] for r in got} == {0}
    assert quotations.linked(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("fixture", [True, False])
def test_against_sql(spark, sf_dir, fixture, tmp_path):
    import duckdb

    name = "op7_quotations"
    if fixture:
        spark.createDataFrame(THREAD, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
        sf_dir, files = str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet"
    else:
        files = f"{sf_dir}/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
    assert compare(common.PLANS[name](spark, sf_dir), con, common.CHECKS[name]) is None

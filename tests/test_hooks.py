import pytest

from codelode.operators.hooks import Reply, converse, with_embeddings


def test_loop_ends_with_an_answer_an_error_or_its_bound(spark):
    def complete(talks):
        out = []
        for talk in talks:
            prompt, said = talk[1]["content"], [m["content"] for m in talk if m["role"] == "tool"]
            if prompt == "forever":
                out.append(Reply("again", [("count", {"n": len(said)})]))
            elif prompt == "tools" and not said:
                out.append(Reply("look", [("count", {"n": 5}), ("none", {}), ("bad", {})]))
            else:
                out.append(Reply(f"done {len(said)}"))
        return out

    def bad(arguments):
        raise OSError("broken")

    df = spark.createDataFrame([("1", "tools", 0), ("2", "forever", 0), ("3", None, 0), ("4", "plain", 0)], "id string, prompt string, rounds int")
    found = {r.id: r for r in converse(df, complete, {"count": lambda a: str(a["n"] + 1), "bad": bad}, most=3, at_once=2).collect()}
    assert (found["1"].answer, found["1"].rounds, found["1"].exhausted) == ("done 3", 2, False)
    assert [(e.tool_name, e.output) for e in found["1"].evidence] == [("count", "6"), ("bad", '{"error": "the tool failed: broken"}')]
    assert (found["2"].answer, found["2"].rounds, found["2"].exhausted, len(found["2"].evidence)) == ("again", 3, True, 3)
    assert found["3"].answer == found["4"].answer == "done 0"

    def failing(talks):
        raise ValueError("no model")

    assert {(r.error, r.rounds) for r in converse(df, failing).collect()} == {("no model", 1)}
    assert converse(df.limit(0), failing).collect() == []


def test_embeddings_by_a_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
    made = {r.id: r.embedding for r in with_embeddings(df, "t", lambda ts: [[len(t), 1] for t in ts], dimensions=2, at_once=1).collect()}
    assert made == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]}
    plain = {r.id: r.embedding for r in with_embeddings(df, "t", dimensions=4).collect()}
    assert len(plain[1]) == 4 and plain[2] is None
    with pytest.raises(Exception, match="instead of 3"):
        with_embeddings(df, "t", lambda ts: [[1.0] for _ in ts], dimensions=3).collect()

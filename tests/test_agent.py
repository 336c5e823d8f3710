"""The loop and the clients."""

import json

import pytest

from chunkwell.operators import tables
from chunkwell.plans import agent, clients
from chunkwell.queries import toolset


def test_loop(spark, sf):
    tools = toolset(spark, sf)
    calls = [agent.Call(agent.TABLE, entity="hot gear", attribute="type"), agent.Call(agent.KEYWORD, query="the")]
    assert agent.SEMANTIC not in tools.available()
    done = agent.ask_all(spark, tools, {1: "a", 2: "b"}, agent.Scripted(calls, 1))
    assert [len(a.trace) for a in done.values()] == [1, 1] and not done[1].hit_cap
    capped = agent.ask_all(spark, tools, {1: "a"}, agent.Scripted(calls))[1]
    assert len(capped.trace) == 6 and capped.hit_cap and capped.trace[1].chunk_ids
    with pytest.raises(ValueError, match="no such tool"):
        agent.ask_all(spark, tools, {1: "a"}, agent.Scripted([agent.Call("other")]))


def test_render(spark):
    chunks = spark.createDataFrame([("c", "d", 3, "S", "official", "x" * 600, None), ("e", "d", None, None, "reference", None, [["a", "b"]])], "id string, doc_id string, page int, section string, reliability_tier string, text string, table array<array<string>>")
    lines = {r["id"]: r["line"] for r in agent.evidence_lines(chunks, chunks).collect()}
    assert lines["c"] == f"  - [d, p.3 § S, official] {'x' * 500}…" and lines["e"] == "  - [d, no page, reference] a b\n"
    text = agent.render([agent.Observation(agent.Call(agent.TABLE, entity='a"b', attribute="c"), ["c"], ["n"]), agent.Observation(agent.Call(agent.FOLLOW, entity="z"))], lines)
    assert text.startswith('\n[1] table_lookup("a\\"b", "c")\n  - n\n  - [d, p.3') and text.endswith('\n[2] follow_reference("z")\n  (no results)\n')


class Model:
    def complete(self, messages, temperature, schema=None):
        keys = set(schema["properties"])
        if "tool" in keys:
            return json.dumps({"tool": schema["properties"]["tool"]["enum"][0], "query": "q", "entity": "", "attribute": "", "reasoning": "r"})
        return json.dumps({"sufficient": True, "reasoning": "r"} if "sufficient" in keys else {"answer": "A", "citations": [], "conflicts": []})


def test_modelled_policy():
    policy = agent.Modelled(Model(), lambda trace: "")
    assert policy.plan("q", [], [agent.KEYWORD]).query == "q" and policy.sufficient("q", []) and policy.synthesize("q", []).text == "A"


def sender(*responses):
    sent = []

    def send(url, headers, body):
        sent.append(body)
        r = responses[min(len(sent), len(responses)) - 1]
        return r if isinstance(r, tuple) else r(body)

    return send, sent


def good(body):
    return 200, json.dumps({"data": [{"embedding": [float(len(t))], "index": i} for i, t in reversed(list(enumerate(body["input"])))]}).encode()


def test_embeddings():
    make = lambda *r: (lambda s: (clients.HttpEmbeddings("u", "k", "m", s[0], most=3, retries=2, sleep=waits.append), s[1]))(sender(*r))
    waits: list[float] = []
    client, sent = make(good)
    assert client.embed(["a", "bb"]) == [[1.0], [2.0]] and client.embed([]) == [] and len(sent) == 1
    assert [len(v) for v in [client.batch_embed(["x"] * 7)]] == [7] and [len(b["input"]) for b in sent[1:]] == [3, 3, 1]
    with pytest.raises(ValueError):
        client.embed(["x"] * 4)
    client, sent = make((429, b""), good)
    assert client.embed(["a"]) == [[1.0]] and len(sent) == 2 and waits == [1.0]
    for status, tries in ((400, 1), (500, 3)):
        client, sent = make((status, b"no"))
        with pytest.raises(clients.CallError):
            client.embed(["a"])
        assert len(sent) == tries
    client, _ = make((200, b'{"data": []}'))
    with pytest.raises(ValueError):
        client.embed(["a"])


def test_completions():
    send, sent = sender((200, b'{"choices": [{"message": {"content": "hi"}}]}'), (200, b'{"choices": []}'))
    client = clients.HttpCompletions("u", "k", "m", send)
    assert client.complete([], 0.0, {"type": "object"}) == "hi" and sent[0]["response_format"]["json_schema"]["strict"]
    with pytest.raises(ValueError):
        client.complete([], 0.0)


@pytest.mark.parametrize("status, failures, tries, waited, done", [(429, 0, 1, 0, True), (429, 2, 3, 3, True), (500, 3, 4, 7, True), (500, 4, 4, 7, False), (400, 1, 1, 0, False), (0, 1, 2, 1, True)])
def test_waits_double(status, failures, tries, waited, done):
    made, waits = [], []

    def send(url, headers, body):
        made.append(1)
        if len(made) > failures:
            return 200, b"{}"
        if not status:
            raise clients.CallError("no response")
        return status, b"no"

    try:
        clients.call(send, "u", {}, {}, sleep=waits.append)
        assert done
    except clients.CallError:
        assert not done
    assert (len(made), sum(waits)) == (tries, waited)


def test_keyword_tool_takes_query_strings(spark):
    texts = spark.createDataFrame([("1", "a red hen"), ("2", "one red fox"), ("3", "a hen")], "id string, text string")
    asked = spark.createDataFrame([(0, 0, agent.KEYWORD, "red -hen", "", ""), (1, 0, agent.KEYWORD, '"red hen" fox~1', "", ""), (2, 0, agent.KEYWORD, "+hen red^3", "", "")], agent.REQUESTS)
    got = agent.dispatch(agent.Toolset(texts=texts), asked).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["rank"], r["chunk_id"]) for r in got] == [(0, 1, "2"), (1, 1, "1"), (2, 1, "1"), (2, 2, "3")]


def test_traces_have_all_that_a_step_finds(spark):
    """More rows than a prompt shows, and equal calls of two questions searched for once."""
    n = agent.MOST_EVIDENCE + 5
    made = spark.range(n).selectExpr("id as ord", "concat('t', id) as id", "'T' as doc_title", "'hot gear' as section", "'table' as chunk_type", "array(array('Type', string(id))) as table")
    asked, seen = [], []
    dispatch = agent.dispatch

    def counted(tools, requests, *more):
        asked.append(requests.count())
        return dispatch(tools, requests, *more)

    agent.dispatch = counted
    try:
        call = agent.Call(agent.TABLE, entity="hot gear", attribute="type")
        done = agent.ask_all(spark, agent.Toolset(tables=tables.table_chunks(made)), {1: "a", 2: "b"}, agent.Scripted([call], 1))
    finally:
        agent.dispatch = dispatch
    assert asked == [1] and all(a.trace[0].chunk_ids == [f"t{i}" for i in range(n)] and len(a.trace[0].notes) == n == len(a.citations) for a in done.values())
    agent.Modelled(Model(), lambda trace: seen.append(len(trace[0].notes)) or "").sufficient("q", done[1].trace)
    assert seen == [agent.MOST_EVIDENCE]


def test_a_question_builds_no_index(spark, sf):
    """The tools of a question search texts, and write what these hold of the asked words only."""
    import glob

    from chunkwell.queries import modelled_answers

    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    made = lambda kind: set(glob.glob(f"{folder.removeprefix('file:')}/**/{kind}-*", recursive=True))
    before = made("index"), made("asked")
    rows = modelled_answers(spark, sf).collect()
    assert made("index") == before[0] and len(made("asked") - before[1]) == 1
    assert len(rows) == 5 and {r["tools"] for r in rows} == {"keyword_search,table_lookup"}

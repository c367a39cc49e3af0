"""Landed sources read incrementally, robots rules, expansion callbacks and text measures."""

import json
import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from heliograph.operators import evaluation, expansion, graphs, stateful
from heliograph.sources import robots
from heliograph.sources.landed import LandedReader, LandedSource


def land(folder, source, number, items):
    (folder / source).mkdir(parents=True, exist_ok=True)
    (folder / source / f"{number:05}.json").write_text("\n".join(map(json.dumps, items)) + "\n\n")


def test_sources_go_on_after_a_restart_without_loss_or_repeats(spark, tmp_path):
    folder, work, sent = tmp_path / "in", str(tmp_path / "work"), []
    spark.dataSource.register(LandedSource)

    def more(source, number, n):
        items = [{"id": f"{source}-{number}-{i}", "text": "é x"} for i in range(n)]
        land(folder, source, number, items)
        sent.extend(x["id"] for x in items)

    def run():
        stream = spark.readStream.format("heliograph_landed").option("path", str(folder)).option("filesPerTask", 2).load()
        out = stateful.run_batches(stream.select("source", F.get_json_object("item", "$.id").alias("id")), work)
        return [r["id"] for r in out.collect()]

    for n in range(1, 4):
        more("a", n, 3)
    more("b", 1, 2)
    assert sorted(run()) == sorted(sent)
    assert sorted(run()) == sorted(sent)  # nothing new
    more("a", 4, 1)
    more("c", 1, 5)  # a new source
    (folder / "a" / "_started.json").write_text("{")
    assert sorted(run()) == sorted(sent)


def test_offsets_of_each_source(tmp_path):
    for n in range(1, 6):
        land(tmp_path, "a", n, [{"n": n}])
    land(tmp_path, "b", 1, [{"n": 1}])
    reader = LandedReader(str(tmp_path), 1, 2)
    first, second = reader.latestOffset(), reader.latestOffset()
    assert first == {"a": "00002.json", "b": "00001.json"} and second == {"a": "00004.json", "b": "00001.json"}
    assert [(p.source, p.names) for p in reader.partitions(first, second)] == [("a", ["00003.json"]), ("a", ["00004.json"])]
    assert [json.loads(r[3])["n"] for p in reader.partitions({}, first) for r in reader.read(p)] == [1, 2, 1]
    assert LandedReader(str(tmp_path / "none"), 1, None).latestOffset() == {}


def test_robots_against_another_parser_and_longest_match(spark):
    rnd = random.Random(5)
    paths = ["/", "/a", "/a/b", "/a/b.html", "/b", "/private/x", "/private/y?q=1"]
    files, urls = [], []
    for i in range(30):
        lines = ["User-agent: *"] + [f"{rnd.choice(['Allow', 'Disallow'])}: {p}" for p in sorted(rnd.sample(paths, 3), key=len, reverse=True)]
        files.append((f"h{i}.org", "\n".join([*lines, "Crawl-delay: 3"])))
        urls += [f"https://h{i}.org{p}" for p in paths]
    found = robots.rules(spark.createDataFrame(files, "host string, content string"))
    got = {r["url"]: r for r in robots.permissions(spark.createDataFrame([(u,) for u in urls], "url string"), found).collect()}
    for host, text in files:
        other = urllib.robotparser.RobotFileParser()  # takes the first match; the rules are in order of length
        other.parse(text.splitlines())
        for p in paths:
            assert got[f"https://{host}{p}"]["allowed"] == other.can_fetch("x", f"https://{host}{p}"), (text, p)
    assert {r["delay"] for r in got.values()} == {3.0}


@pytest.mark.parametrize(
    "rule, path, matches",
    [("/a*b", "/axxb/c", True), ("/a*b$", "/axxb/c", False), ("/a*b$", "/axxb", True), ("/*.php$", "/x/y.php", True), ("/*.php$", "/x/y.php5", False), ("/a.b", "/axb", False), ("/a?x=(1)", "/a?x=(1)&y", True), ("/a$b", "/a$bc", True), ("/", "/anything", True), ("/50%", "/50%off", True)],
)
def test_robots_patterns(spark, rule, path, matches):
    found = spark.createDataFrame([("h.org", "*", rule, False, None)], robots.RULES)
    row = robots.permissions(spark.createDataFrame([(f"http://h.org{path}",)], "url string"), found).first()
    assert row["allowed"] != matches


def test_robots_agents():
    text = "# c\nUser-agent: A\nUser-agent: b # x\nDisallow: /p\n\nUser-Agent: *\nDisallow:\nCrawl-Delay: 1.5\nnonsense"
    assert list(robots.parse(text)) == [("a", "/p", False, None), ("b", "/p", False, None), ("*", "/", True, None), ("*", None, None, 1.5)]
    assert list(robots.parse("")) == [] and list(robots.parse(None)) == []


def test_registered_expansion_gives_the_same_crawl(spark):
    rnd = random.Random(2)
    links = {i: [(rnd.randrange(60), rnd.random()) for _ in range(rnd.randrange(6))] for i in range(60)}
    edges = spark.createDataFrame([(a, b, p) for a, out in links.items() for b, p in dict(out).items()], "src long, dst long, priority double")
    nodes = spark.createDataFrame([(a, json.dumps(list(dict(out).items()))) for a, out in links.items()], "node long, payload string")
    expansion.register(spark, "expand_test", lambda node, payload: json.loads(payload))
    starts = spark.createDataFrame([(0,), (7,)], "node long")
    got = expansion.crawl(nodes, starts, "expand_test", 3, 2, 0.3)
    want = graphs.crawl(edges, starts, 3, 2, 0.3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("node", "depth").collect()))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequences():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(90))] for _ in range(2))
        assert evaluation.common_subsequence(a, b) == lcs(a, b)


def test_bleu_of_known_texts(spark):
    same = spark.createDataFrame([(1, "the cat sat on the mat".split(), "the cat sat on the mat".split())], "k long, g array<string>, t array<string>")
    assert evaluation.bleu(same, ["k"], "g", "t").first()["bleu"] == pytest.approx(100)
    clipped = spark.createDataFrame([(1, "the the the the the".split(), "the cat is on the mat".split())], "k long, g array<string>, t array<string>")
    row = evaluation.bleu(clipped, ["k"], "g", "t").first()
    import math

    logs = math.log(100 * 2 / 5) + math.log(100 / (2 * 4)) + math.log(100 / (4 * 3)) + math.log(100 / (8 * 2))
    assert row["bleu"] == pytest.approx(math.exp(1 - 6 / 5) * math.exp(logs / 4))
    assert evaluation.bleu(same.where("false"), ["k"], "g", "t").first()["bleu"] == 0


def test_regressions(spark):
    before = spark.createDataFrame([("bleu", 30.0), ("perplexity", 10.0), ("latency_ms", 5.0), ("f1", 0.5), ("none", None)], "metric string, value double")
    now = spark.createDataFrame([("bleu", 28.0), ("perplexity", 10.4), ("latency_ms", 6.0), ("f1", 0.6), ("none", 1.0)], "metric string, value double")
    assert {r["metric"]: r["regressed"] for r in evaluation.regressions(before, now).collect()} == {"bleu": True, "perplexity": False, "latency_ms": True, "f1": False}


def test_exemplar_banks_and_priors(spark, tmp_path):
    from heliograph.sources import exemplars

    rows = [("bug", "it broke", [0.1, 0.2], None, None), ("ask", "how", [1.0], ["X"], "reddit")]
    exemplars.save_bank(spark.createDataFrame(rows, exemplars.BANK), str(tmp_path / "bank"))
    got = {r["signal_type"]: r for r in exemplars.load_bank(spark, str(tmp_path / "bank"), ["bug", "ask"]).collect()}
    assert got["bug"]["embedding"] == [0.1, 0.2] and got["bug"]["entities"] == [] and got["bug"]["platform"] == ""
    assert exemplars.load_bank(spark, str(tmp_path / "bank"), ["bug"]).count() == 0
    assert exemplars.load_bank(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "array.json").write_text(json.dumps([{"signal_type": "bug", "text": "t", "embedding": [1.5]}, {"signal_type": "bug", "text": "u", "embedding": [2]}], indent=1))
    assert exemplars.load_bank(spark, str(tmp_path / "array.json")).count() == 2
    (tmp_path / "half.json").write_text(json.dumps([{"signal_type": "bug", "text": "t"}]))
    assert exemplars.load_bank(spark, str(tmp_path / "half.json")).count() == 0

    built_in = {(p, t): v for p, ts in exemplars.PRIORS.items() for t, v in ts.items()}
    table = lambda df: {(r["platform"], r["signal_type"]): r["prior"] for r in df.collect()}
    (tmp_path / "priors.json").write_text(json.dumps({"Reddit": {"bug": 0.5}, "x": {"ask": 0.25, "bug": 1}}, indent=2))
    assert table(exemplars.load_priors(spark, str(tmp_path / "priors.json"))) == {("reddit", "bug"): 0.5, ("x", "ask"): 0.25, ("x", "bug"): 1.0}
    (tmp_path / "bad.json").write_text("{not json")
    for path, types in ((None, None), (str(tmp_path / "none"), None), (str(tmp_path / "bad.json"), None), (str(tmp_path / "priors.json"), ["bug"])):
        assert table(exemplars.load_priors(spark, path, types)) == built_in

import random

import pytest

from pagelode.llm import truncation as tr


@pytest.mark.parametrize("text, ending", [
    (None, None), ("", None), (" \n​", None), ("It ends.", "stop"), ("It ends.\n\n", "stop"), ("\"It ends.\"", "stop"), ("終わります。", "stop"), ("It is sl [...]", "mark"), ("It is sl [cut]", "mark"),
    ("It ends…", "ellipsis"), ("It ends...", "ellipsis"), ("It broke �", "broken"), ("```\ncode", "open"), ("```\ncode\n```", "closed"), ("See [the pa", "open"), ("See [the page](../a", "open"), ("See <a href=\"/x", "open"),
    ("<pre>code", "open"), ("<p>It ends.</p>", "closed"), ("<p>It is slo", "line"), ("| a | b |\n|---|---|\n| 1 | 2 |", "closed"), ("| a | b |\n|---|---|\n| 1 |2", "open"), ("- one\n- two", "item"), ("# Title", "heading"),
    ("{{Box\n| a = 1", "open"), ("if (a < 3) { x }\n\nIt ends.", "stop"), ("a (b c.", "stop"), ("It just sto", "line"), ("Fish &am", "broken"),
])
def test_endings(text, ending):
    got = tr.read_end(text)
    assert (got and got[0]) == ending


def test_lengths_without_the_mark():
    assert tr.read_end("abc de [...]")[3:] == (6, 6)
    assert tr.read_end("é" * 4)[3:] == (4, 8)


NOUNS = "anchor bottle candle desert engine feather garden hammer island jacket kettle ladder".split()
ADJ = "amber brittle clever dusty early fragile gentle hollow".split()


def sentence(rng):
    a, b, c = rng.choice(ADJ), rng.choice(NOUNS), rng.choice(NOUNS)
    return rng.choice([f"The {a} {b} carries the {c}.", f"Every {b} needs one {c} and a {a} {rng.choice(NOUNS)}.", f"Without a {b} the {c} stays {a}."])


def corpus(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["limited", "limited", "free"])
        text = "\n\n".join(" ".join(sentence(rng) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6)))
        tail = rng.random()
        if tail < 0.1:
            text += "\n\n" + "\n".join(f"- Move the {rng.choice(ADJ)} {rng.choice(NOUNS)}" for _ in range(3))
        elif tail < 0.2:
            text += f"\n\nVersion {rng.randint(0, 9)}.{rng.randint(0, 30)}"
        elif tail < 0.25:
            text = text[:-1] + "…"
        is_cut = False
        if source == "limited" and len(text) > 400 and rng.random() < 0.5:
            text, is_cut = text[:400], True
        elif rng.random() < 0.05:
            text, is_cut = text[: rng.randint(20, len(text) - 2)] + rng.choice(["", "", "…", " [...]"]), True
        body = text.rstrip("… [].")
        if is_cut and text == text.rstrip("… []") and text.rstrip()[-1:] in ".":
            is_cut = False  # cut right after a sentence: nothing is missing
        rows.append((i, source, text, is_cut, body))
    return rows


@pytest.mark.parametrize("sent", [100_000, 0])
def test_held_out_accuracy(spark, monkeypatch, sent):
    """Alike whether the baselines are sent or joined."""
    monkeypatch.setattr(tr, "SENT_ROWS", sent)
    rows = corpus()
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, text string")
    got = {r["doc_id"] for r in tr.judge_ends(df).where("cut").collect()}
    want = {r[0] for r in rows if r[3]}
    assert len(got & want) >= 0.93 * len(want)
    assert len(got & want) >= 0.95 * len(got)


def test_report_and_odd_rows(spark):
    rows = [(1, "a", "It just sto", 1), (2, "a", None, 1), (3, None, "See [x", 1), (4, None, "", 1), (5, "b", "Fine.", 1), (5, "b", "Fine.", 1), (6, "b", "word " * 100000, 1), (None, "b", "Fine.", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, cut int")
    judged = tr.judge_ends(df)
    assert sorted(r["doc_id"] for r in judged.where("cut").collect()) == [1, 3, 6]
    report = {r["source"]: (r["docs"], r["cut"]) for r in tr.source_report(df, judged).collect()}
    assert report == {"a": (2, 1), None: (2, 1), "b": (4, 1)}
    assert tr.judge_ends(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, ending", [
    ("See it here.\n\n<img alt=x src=\"data:image/png;base64," + "iVBORw0K" * 90 + ";", "open"),
    ("A box.\n\n<div class=\"wide\"\n  id=\"a\"\n  style=\"color: red;", "open"),
    ("If a <b and more, then so. " + "It goes on like this. " * 30, "stop"),
    ("A box:\n\n```\n<div class=\"wide\"\n  style=\"color: red;\n```\n\nThat is all.", "stop"),
])
def test_unfinished_tags_of_any_length(text, ending):
    assert tr.read_end(text)[0] == ending


def test_source_habits_and_forms(spark):
    """A source of titles ends without terminators by habit, and another's signature is its own closing line; elsewhere the same ends are cuts."""
    rng = random.Random(4)
    rows = [(i, "titles", f"The {rng.choice(ADJ)} {rng.choice(NOUNS)}") for i in range(300)]
    rows += [(1000 + i, "prose", " ".join(sentence(rng) for _ in range(3))) for i in range(3000)]
    rows += [(5000 + i, "letters", " ".join(sentence(rng) for _ in range(2)) + "\n\nYours, the keeper") for i in range(60)]
    rows += [(9000, "prose", "Every anchor needs one\n\nThe dusty ham"), (9001, "prose", sentence(rng) + " The dusty"), (9002, "titles", "The dusty xqz")]
    got = {r["doc_id"] for r in tr.judge_ends(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("cut").collect()}
    assert got == {9000, 9001, 9002}


def test_ends_are_judged_alike_at_every_size(spark):
    """Shares decide: the same documents five times over are judged as once."""
    rows = [r[:3] for r in corpus(1500, seed=9)]
    schema = "doc_id long, source string, text string"
    once = {r["doc_id"]: r["cut"] for r in tr.judge_ends(spark.createDataFrame(rows, schema)).collect()}
    more = [(i + 10_000 * n, s, t) for n in range(5) for i, s, t in rows]
    many = {r["doc_id"]: r["cut"] for r in tr.judge_ends(spark.createDataFrame(more, schema)).where("doc_id < 10000").collect()}
    assert sum(once[i] != many[i] for i in once) <= 0.01 * len(once)


@pytest.mark.parametrize("text", ["<p>" * 40_000 + "</b>" * 40_000, "a1" * 100_000, "1 2 3 " * 50_000 + ". " + "x. " * 50_000, "a " * 100_000 + "<b x", "(" * 100_000])
def test_time_is_linear(text):
    import time
    from collections import Counter

    began = time.perf_counter()
    tr.read_end(text), tr.line_ends(text, Counter())
    assert time.perf_counter() - began < 3

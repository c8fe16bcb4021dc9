"""Texts that were cut off (problem 9).

A stack automaton reads each text and keeps what is open: fences, brackets and quotes
of the paragraph, tags, templates, tables, environments. What is still open at the end,
a broken last character or escape, or a truncation mark is a cut by itself. Where the
structure is closed, the last line decides: one that ends like a sentence is complete,
and of the others it is asked how such lines end elsewhere.

That baseline is counted over all documents, and per source: with which words sentences,
list items, headings and lines of code end before more text follows, against how many
documents hold the word at all; which short closing lines (a version, a signature) many
documents, or many of the source, end with; how many of a source's documents end without
a terminator at all; and at which length a source's texts pile up, in characters or
bytes, as texts do that a field limit has cut. All of it is judged by shares, and by how
far a share is beyond chance, so the same text is judged alike in a small and a large table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.llm.markup import HTML_NAMES
from pagelode.llm.stage import HOT_KEYS, cut, look_up

FENCE = re.compile(r"^[^\S\n]*(`{3,}|~{3,})[^\n`]*$", re.MULTILINE)
TAG = re.compile(rf"<(/?)({HTML_NAMES.replace(' ', '|')})(?![\w-])[^<>]*?(/?)>", re.IGNORECASE)
#: A tag that has just begun, or goes on with attributes and nothing else; any length.
HALF_TAG = re.compile(
    r"<[/!]?(?:[A-Za-z][\w.:-]*(?:\s+[A-Za-z_:@][\w:.@-]*(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+))?)*"
    r"(?:\s+[A-Za-z_:@][\w:.@-]*=(?:\"[^\"<>]*|'[^'<>]*)?)?\s*/?)?$"
)
#: A tag of HTML with an attribute may hold anything.
LONG_HALF_TAG = re.compile(rf"(?<!`)<(?:{HTML_NAMES.replace(' ', '|')})\s+[\w:@.-]+\s*=[^<>]*$", re.IGNORECASE)
#: The longest of these marks has eleven characters, so they are looked for in that many.
MARK = re.compile(r"(?:\[(?:\.\.\.|…|cut|truncated|snip|more)\]|\((?:truncated|cut|more)\)|<truncated>)$", re.IGNORECASE)
LONGEST_MARK = 11
#: Likewise: the longest half escape has ten.
HALF_ESCAPE = re.compile(r"(?:&(?:#\w{0,7}|[A-Za-z]{2,8})|\\u[0-9A-Fa-f]{0,3}|\\x[0-9A-Fa-f]?|%[0-9A-F]?)$")
LONGEST_ESCAPE = 10
STOPS, CLOSING = ".!?。！？؟।:;", ")]}\"'”’»」』*_`"
ITEM = re.compile(r"^[^\S\n]*(?:[-*+•]|\d{1,3}[.)])[^\S\n]+")
HEADING = re.compile(r"^#{1,6}[^\S\n]|^={1,6}[^=]")
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr", "area", "base", "embed", "source", "track"}
#: Tags whose end is often left out; they tell nothing where the text below them is complete.
OPTIONAL = {"p", "li", "td", "th", "tr", "dt", "dd", "option", "thead", "tbody", "tfoot", "html", "body", "head", "span", "div"}
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "』": "『", "）": "（"}
OPENERS = set(PAIRS.values())
BRACKETS = re.compile(r"[()\[\]{}“”«»「」『』（）\"`]|\[\[|\]\]")
#: Kinds of interior line ends that are counted, and the documents that hold a word anywhere.
SENTENCE, LIST, TITLE, SOURCE, ANYWHERE = "sentence", "item", "heading", "code", "any"
#: A word can be an end if it is one in that share of the documents that hold it, beyond chance, and that share of all documents hold it.
END_SHARE, KNOWN_SHARE = 0.005, 2e-4
#: Standard deviations beyond chance.
SURELY = 2.0
#: The word before the last of a sentence, and the two together. Two words that would often end
#: a sentence if they met by chance, and hardly ever do, do not end one ("the large", of "the large file").
BEFORE, PAIR = "before", "pair"
BY_CHANCE, SELDOM = 8, 0.02
#: Endings that decide by themselves.
CUT_ENDINGS, WHOLE_ENDINGS = ("mark", "broken", "open"), ("stop", "closed")
#: Share of the other documents, or of the source's other documents, that must end with a closing line of one form.
CLOSING_SHARE, SOURCE_CLOSING_SHARE = 0.002, 0.02
#: A source most of whose texts end without a terminator, away from a limit, ends them so by habit.
HABIT = 0.5
#: A pile: that share of the source's texts, so many times the mean of the lengths around it, and so many deviations above it.
PILE_SHARE, PILE_TIMES, PILE_DEVIATIONS, AROUND = 0.002, 8, 5, 30
#: And so many times each of the lengths next to it.
NEXT_TO, NEXT_TIMES = 5, 3

#: Rows of a baseline that are sent to all tasks; more are joined by a shuffle, with the same result.
SENT_ROWS = 100_000

LETTERS = re.compile(r"[^\W\d_]+")
#: A terminator before more text; the closing signs before it belong to it.
TERMINATOR = re.compile(r"[.!?](?=\s+\S)|[。！？](?=\s*\S)")
CLOSERS = frozenset(")]\"'”’»*_")
#: From this character on scripts write no spaces; the last two characters stand for the word.
SPACELESS = 0x3040


def visible(text: str) -> str:
    """The text without blank, control and format characters at its end."""
    end = len(text)
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("Cc", "Cf")):
        end -= 1
    return text[:end]


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def ends_with_stop(line: str) -> bool:
    """Whether a line ends like a sentence, closing signs apart."""
    body = line.rstrip(CLOSING)
    return bool(body) and body[-1] in STOPS


def word_key(word: str) -> str:
    word = word.lower()
    return word[-2:] if ord(word[-1]) >= SPACELESS else word


def last_two(segment: str) -> tuple[str, str]:
    """(the word before the last, the last) of a stretch of one sentence; '' where there is none.

    The last word must end the stretch, but for signs, and the one before must stand in the
    same or the next blank-separated token.
    """
    tokens = segment.rsplit(None, 2)[-2:]
    joined = " ".join(tokens)
    end = len(joined)
    while end and not (joined[end - 1].isalnum() or joined[end - 1] == "_"):
        end -= 1
    if not end or not _is_letter(joined[end - 1]):
        return "", ""
    words = LETTERS.findall(joined, 0, end)[-2:]
    return words[0].lower() if len(words) > 1 and ord(words[-1][-1]) < SPACELESS else "", words[-1]


def last_sentence(line: str) -> str:
    """What follows the last terminator within a line."""
    at = 0
    for m in TERMINATOR.finditer(line):
        at = m.end()
    return line[at:]


def last_word(line: str) -> str:
    """The last run of letters, lower case; of scripts without spaces the last two characters; else the last token, digits as 0."""
    word = last_two(line)[1]
    if word:
        return word_key(word)
    tokens = line.rsplit(None, 1)
    return re.sub(r"\d", "0", tokens[-1]) if tokens else ""


def closing_form(line: str) -> str:
    """What short closing lines have in common: first and last word and length, digits as 0 and paths as /."""
    words = re.sub(r"\d+", "0", re.sub(r"\S*/\S*", "/", line.lower())).split()
    return "" if not words or len(words) > 6 else f"{words[0]} {words[-1]} {len(words)}"


def open_at_end(text: str) -> str:
    """What the automaton has on its stack at the end of the text: a name, or '' if nothing."""
    fence = ""
    after = 0
    for m in FENCE.finditer(text) if "```" in text or "~~~" in text else ():
        sign = m.group(1)
        if not fence:
            fence = sign
        elif sign[0] == fence[0] and len(sign) >= len(fence):
            fence, after = "", m.end()
    if fence:
        return "fence"
    stack: list[str] = []
    opened: Counter[str] = Counter()
    if "<" in text:
        for m in TAG.finditer(text):
            name = m.group(2).lower()
            if name in VOID or m.group(3):
                continue
            if not m.group(1):
                stack.append(name)
                opened[name] += 1
            elif opened[name]:
                while (last := stack.pop()) != name:
                    opened[last] -= 1
                opened[name] -= 1
    required = [t for t in stack if t not in OPTIONAL]
    if required:
        return f"<{required[-1]}>"
    if text.rfind("<!--") > text.rfind("-->"):
        return "comment"
    if text.count("{{") > text.count("}}"):
        return "template"
    if len(re.findall(r"^\{\|", text, re.MULTILINE)) > len(re.findall(r"^\|\}", text, re.MULTILINE)):
        return "table"
    if text.count("\\begin{") > text.count("\\end{"):
        return "environment"
    # Brackets and quotes of the last paragraph only: an open one before it did not end the text.
    para = text[max(after, text.rfind("\n\n") + 1, text.rfind("\n- ") + 1, text.rfind("\n* ") + 1) :]
    open_now: list[str] = []
    for m in BRACKETS.finditer(para):
        c = m.group()[0]
        if c in "\"`":
            if open_now and open_now[-1] == c:
                open_now.pop()
            else:
                open_now.append(c)
        elif c in OPENERS:
            open_now.append(c)
        elif open_now and open_now[-1] == PAIRS[c]:
            open_now.pop()
    half = text.rfind("<")
    if half >= after and half > text.rfind(">") and (HALF_TAG.match(text, half) or LONG_HALF_TAG.match(text, half)):
        return "tag"
    line = text[text.rfind("\n") + 1 :]
    if open_now and not ends_with_stop(line) and not (line.endswith(">") and TAG.search(line)):
        return open_now[-1]
    return ""


def read_end(text: str | None) -> tuple[str, str, str, int, int] | None:
    """(ending, last word, word before it or closing form, characters, bytes) of a text; None for null, empty and blank ones.

    Endings: mark, broken, open, ellipsis, stop, closed, item, heading, code, line. Lengths are without what a mark added.
    """
    if not text:
        return None
    t = visible(text)
    if not t:
        return None
    m = MARK.search(t[-LONGEST_MARK:])
    if m is not None:
        rest = t[: len(t) - len(m.group())].rstrip()
        rest = rest[:-1].rstrip() if rest.endswith("…") else rest[:-3].rstrip() if rest.endswith("...") else rest
        if rest:
            return "mark", "", "", len(rest), len(rest.encode("utf-8", "replace"))
    size = len(text), len(text.encode("utf-8", "replace"))
    if t[-1] == "�":
        return "broken", "", "", *size
    body = t[:-1].rstrip() if t.endswith("…") else t.rstrip(".").rstrip() if t.endswith("...") else t
    dots = 0 < len(body) < len(t)
    body = body if dots else t
    line = body[body.rfind("\n") + 1 :]
    state = open_at_end(body)
    if state:
        return "open", "", "", *size
    if dots:
        return "ellipsis", last_word(line), last_two(last_sentence(line))[0], *size
    if FENCE.match(line.strip()) or (TAG.search(line) and line.endswith(">")):
        return "closed", "", "", *size
    if line.lstrip().startswith("|"):
        return ("closed" if line.rstrip().endswith(("|", "|}")) else "open"), "", "", *size
    if line.startswith(("    ", "\t")) and not ITEM.match(line):
        return SOURCE, last_word(line), "", *size
    if HEADING.match(line):
        return TITLE, last_word(line), "", *size
    if ITEM.match(line) and not ends_with_stop(line):
        return LIST, last_word(line), "", *size
    if ends_with_stop(line) or line.endswith(("}}", "]]", "|}")):
        return "stop", "", "", *size
    if HALF_ESCAPE.search(line[-LONGEST_ESCAPE:]):
        return "broken", "", "", *size
    alone = body[: len(body) - len(line)].endswith("\n\n") or body[: len(body) - len(line)].endswith("\r\n\r\n")
    return "line", last_word(line), closing_form(line) if alone else "", *size


def words_anywhere(text: str) -> set[str]:
    """All words of a text as ``last_word`` would name them."""
    out = set()
    for word in LETTERS.findall(text.lower()):
        if word[-1] < chr(SPACELESS) and word.isascii():
            out.add(word)
        else:
            out.update(word[max(0, i - 1) : i + 1] for i, c in enumerate(word) if ord(c) >= SPACELESS)
            if ord(word[-1]) < SPACELESS:
                out.add(word)
    return out


def line_ends(text: str | None, counts: Counter[tuple[str, str]]) -> None:
    """Counts a text's words, and with which of them its sentences and lines end before more text follows."""
    if not text:
        return
    seen = {(ANYWHERE, w) for w in words_anywhere(text)}
    pairs = set()
    after = 0
    for m in TERMINATOR.finditer(text):
        end = m.start()
        while end and text[end - 1] in CLOSERS:
            end -= 1
        if end > after and text[end - 1].isalpha():
            pairs.add(last_two(text[max(after, text.rfind("\n", after, end) + 1) : end]))
        after = m.end()
    for a, b in pairs:
        seen.add((SENTENCE, word_key(b)))
        if a:
            seen.update({(BEFORE, a), (PAIR, f"{a} {b.lower()}")})
    fenced = False
    for line in text.split("\n")[:-1]:
        bare = line.strip()
        if not bare or (bare[0].isalpha() and not line[0].isspace()):
            continue
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif fenced:
            continue
        elif ITEM.match(line):
            seen.add((LIST, last_word(bare)))
        elif HEADING.match(bare):
            seen.add((TITLE, last_word(bare)))
        elif line.startswith(("    ", "\t")):
            seen.add((SOURCE, last_word(bare)))
    counts.update(seen)


def end_baseline(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, word, n): how many documents hold a word, and in how many it ends a sentence or a line of that kind, or stands before such an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for t in batch.column(0).to_pylist():
                line_ends(t, counts)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["kind", "word", "n"],
            )

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, word string, n bigint")
    return rows.groupBy("kind", "word").agg(F.sum("n").alias("n"))


def read_ends(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, ending, word, form, chars, bytes) of every document that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "source", "ending", "word", "form", "chars", "bytes"]
        for batch in batches:
            got = [read_end(t) for t in batch.column(2).to_pylist()]
            at = pa.array([i for i, g in enumerate(got) if g is not None], pa.int64())
            kept = [g for g in got if g is not None]
            columns = [pa.array([g[i] for g in kept], pa.string() if i < 3 else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=names)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, source string, ending string, word string, form string, chars bigint, bytes bigint")


def length_piles(ends: DataFrame) -> DataFrame:
    """(source, unit, length, n): lengths at which a source's texts pile up.

    Counted over all texts of the source; a pile stands out from the lengths around it, in
    times their mean and beyond chance, and from each of the nearest, and is a share of the
    source's texts. In bytes the lengths just below are those of texts cut before a long character,
    so they may hold as many texts, but no more.
    """
    sized = ends.select("source", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "length"))
    counts = cut(sized.groupBy("source", "unit", "length").agg(F.count("*").alias("n")))
    texts = counts.where("unit = 'chars'").groupBy("source").agg(F.sum("n").alias("_texts"))
    lengths = Window.partitionBy("source", "unit").orderBy("length")
    mean = (F.sum("n").over(lengths.rangeBetween(-AROUND, AROUND)) - F.col("n")) / (2 * AROUND)
    most = lambda low, high: F.coalesce(F.max("n").over(lengths.rangeBetween(low, high)), F.lit(0))
    below = F.when(F.col("unit") == "chars", most(-NEXT_TO, -1)).otherwise(F.greatest(most(-NEXT_TO - 3, -4), most(-3, -1) / NEXT_TIMES))
    beside = F.greatest(below, most(1, NEXT_TO))
    stands_out = (
        (F.col("n") >= PILE_TIMES * F.col("_mean")) & (F.col("n") - F.col("_mean") >= PILE_DEVIATIONS * F.sqrt(F.col("_mean") + 1))
        & (F.col("n") >= NEXT_TIMES * F.col("_beside"))
    )
    piles = counts.withColumns({"_mean": mean, "_beside": beside}).where(stands_out).join(texts, "source").where(F.col("n") >= PILE_SHARE * F.col("_texts"))
    return piles.select("source", "unit", "length", "n")


def at_least(part: Column, whole: Column) -> Column:
    """The lower bound of a share, ``SURELY`` standard deviations off (Wilson's)."""
    z = SURELY * SURELY
    p = part / whole
    return (p + z / (2 * whole) - SURELY * F.sqrt(p * (1 - p) / whole + z / (4 * whole * whole))) / (1 + z / whole)


def possible_ends(baseline: DataFrame, documents: int) -> DataFrame:
    """(ask, ends): the kinds and words, as "kind word", that end sentences or lines often enough, and in how many documents."""
    ends = baseline.where(~F.col("kind").isin(ANYWHERE, BEFORE, PAIR)).withColumnRenamed("n", "ends")
    held = baseline.where(F.col("kind") == ANYWHERE).select("word", F.col("n").alias("held"))
    whole = F.greatest(F.coalesce("held", F.lit(0)), F.col("ends"))
    known = ends.join(held, "word", "left").where((at_least(F.col("ends"), whole) >= END_SHARE) & (whole >= KNOWN_SHARE * documents))
    return known.select(F.concat_ws(" ", "kind", "word").alias("ask"), "ends")


def _asked(rows: DataFrame, name: str, ask: Column, table: DataFrame, total: int) -> DataFrame:
    """Rows with the table's columns where ``ask`` is its key ``name``.

    The tables are of words, forms and lengths, so they are mostly small enough to send. One
    that is not is joined by a shuffle in which keys of very many rows do not gather in one task.
    """
    asked = rows.withColumn(name, ask)
    if table.count() <= SENT_ROWS:
        return asked.join(F.broadcast(table), name, "left").drop(name)
    hot = asked.groupBy(name).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(1_000, -(-total // HOT_KEYS))).select(name)
    return look_up(asked, table, name, hot, "key").drop(name)


def _closing_forms(ends: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(form), at most 1 / ``CLOSING_SHARE`` of them, and (source_form): closing lines that many documents end with, or many of a source."""
    lines = ends.where("ending = 'line' AND form <> ''")
    forms = lines.groupBy("form").agg(F.count("*").alias("_n")).where(F.col("_n") - 1 >= F.greatest(F.lit(CLOSING_SHARE * (total - 1)), F.lit(1)))
    texts = ends.groupBy("source").agg(F.count("*").alias("_texts"))
    own = lines.groupBy("source", "form").agg(F.count("*").alias("_n")).join(texts, "source").where(
        F.col("_n") - 1 >= F.greatest(SOURCE_CLOSING_SHARE * (F.col("_texts") - 1), F.lit(1))
    )
    return forms.select("form", F.lit(True).alias("_form")), own.select(F.concat_ws("\0", "source", "form").alias("source_form"), F.lit(True).alias("_own"))


def judge_ends(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, ending, at_limit, cut) of every document that is not blank. Null sources are one source of their own.

    Keys need not be unique; every row is judged by itself.
    """
    ends = cut(read_ends(docs, key, source, text).withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    total = ends.count()
    baseline = cut(end_baseline(docs, text))
    known = cut(possible_ends(baseline, total))
    piles = cut(length_piles(ends))
    sizes = [("chars", F.col("length")), ("bytes", F.explode(F.sequence(F.col("length") - 3, F.col("length"))))]  # bytes may fall short by the rest of a character
    sized = ends
    for unit, length in sizes:
        table = piles.where(F.col("unit") == unit).select("source", length.alias("length")).distinct()
        table = table.select(F.concat_ws("\0", "source", F.col("length").cast("string")).alias("_pile"), F.lit(True).alias(f"_{unit}"))
        sized = _asked(sized, "_pile", F.concat_ws("\0", "source", F.col(unit).cast("string")), table, total)
    limit = F.coalesce("_chars", F.lit(False)) | F.coalesce("_bytes", F.lit(False))
    sized = cut(sized.withColumn("at_limit", limit).select("key", "source", "ending", "word", "form", "at_limit"))
    # Each branch joins only what it asks about, so rows that need no answer gather under no key.
    decided = sized.where(sized["ending"].isin(*CUT_ENDINGS, *WHOLE_ENDINGS)).withColumn("cut", F.col("ending").isin(*CUT_ENDINGS))

    forms, own_forms = _closing_forms(ends, total)
    lines = sized.where("ending = 'line'").join(F.broadcast(forms), "form", "left")
    formed = _asked(lines.where("_form IS NULL AND form <> ''"), "source_form", F.concat_ws("\0", "source", "form"), own_forms, total)
    formed = formed.unionByName(lines.where("_form IS NOT NULL OR form = ''").withColumn("_own", F.lit(None).cast("boolean")))
    bare = F.col("_form").isNull() & F.col("_own").isNull()
    formed = cut(formed.withColumn("bare", bare))
    texts = ends.groupBy("source").agg(F.count("*").alias("_texts"))
    without = formed.where("bare AND NOT at_limit").groupBy("source").agg(F.count("*").alias("_bare"))
    habit = texts.join(without, "source").where(at_least(F.col("_bare"), F.col("_texts")) >= HABIT).select("source", F.lit(True).alias("_habit"))
    anywhere = baseline.where((F.col("kind") == ANYWHERE) & (F.col("n") > 1) & (F.col("n") >= KNOWN_SHARE * total)).select(F.col("word").alias("_word"), F.lit(True).alias("_whole"))
    lines = formed.where("at_limit OR NOT bare").withColumn("cut", F.col("bare") | F.col("at_limit"))
    usual = _asked(formed.where("bare AND NOT at_limit"), "_source", F.col("source"), habit.withColumnRenamed("source", "_source"), total)
    unusual = usual.where("_habit IS NULL").withColumn("cut", F.lit(True))
    by_word = _asked(usual.where("_habit"), "_word", F.col("word"), anywhere, total).withColumn("cut", F.col("_whole").isNull())

    kind = F.when(F.col("ending") == "ellipsis", F.lit(SENTENCE)).otherwise(F.col("ending"))
    worded = _asked(sized.where(sized["ending"].isin("ellipsis", LIST, TITLE, SOURCE)), "ask", F.concat_ws(" ", kind, "word"), known, total)
    plain = worded.where("ending <> 'ellipsis' OR form = ''").withColumn("cut", F.col("at_limit") | F.col("ends").isNull())
    before = baseline.where(F.col("kind") == BEFORE).select(F.col("word").alias("_first"), F.col("n").alias("_before"))
    met = baseline.where(F.col("kind") == PAIR).select(F.col("word").alias("_pair"), F.col("n").alias("_met"))
    dotted = worded.where("ending = 'ellipsis' AND form <> ''")
    dotted = _asked(_asked(dotted, "_first", F.col("form"), before, total), "_pair", F.concat_ws(" ", "form", "word"), met, total)
    expected = F.coalesce("_before", F.lit(0)) * F.col("ends") / max(total, 1)
    never_met = (expected >= BY_CHANCE) & (F.coalesce("_met", F.lit(0)) < SELDOM * expected)
    dotted = dotted.withColumn("cut", F.col("at_limit") | F.col("ends").isNull() | never_met)
    columns = ["key", "source", "ending", "at_limit", "cut"]
    judged = decided.select(*columns)
    for part in (lines, unusual, by_word, plain, dotted):
        judged = judged.unionByName(part.select(*columns))
    name = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30))
    return judged.select(F.col("key").alias(key), name.alias("source"), "ending", "at_limit", "cut")


def source_report(docs: DataFrame, judged: DataFrame, source: str = "source") -> DataFrame:
    """(source, docs, cut, share, at_limit, unterminated): how many of each source's documents are cut, and how many end without a terminator.

    Blank documents count as documents.
    """
    every = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"))
    cuts = judged.groupBy("source").agg(
        F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("at_limit"),
        F.count_if(~F.col("ending").isin(*WHOLE_ENDINGS)).alias("unterminated"),
    )
    joined = every.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    none = F.lit(0)
    return joined.select(
        "source", "docs", F.coalesce("cut", none).alias("cut"), (F.coalesce("cut", none) / F.col("docs")).alias("share"),
        F.coalesce("at_limit", none).alias("at_limit"), F.coalesce("unterminated", none).alias("unterminated"),
    )

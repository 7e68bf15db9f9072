import base64
import html
import json
import random
import re

import pytest

from vertexlake.llm import truncation as T

HEAD = "From: Anna Berg <a@b.test>\nSubject: x\nContent-Type: text/plain; charset=utf-8\n"
TEXT = "Dear all,\n\nWe moved the pump before the meeting. Please send the list."


def at_limit(verdict):
    return verdict in ("cut", "edge")


@pytest.mark.parametrize(
    "body,cut",
    [
        (TEXT, False),
        (TEXT + "\n\nKind regards,\nAnna", False),
        (TEXT + "\n\n-- \nAnna Berg\n+1 (555) 0100", False),
        (TEXT + "\n\n-- \nAnna Berg\nhttp://b.test/~anna\n\n\n", False),
        (TEXT + "\n\n_____\nlist\nhttp://lists.test/options/list", False),
        (TEXT + "\n\nthanks", False),
        (TEXT + "\n\nP.S. bring the pump", False),
        (TEXT + "\n\n\U0001f642", False),
        (TEXT + "\n\npump\t12\t0.25\nlist\t7\t0.50", False),
        (TEXT + "\n\n* one pump\n* two lists", False),
        ("+1", False),
        (TEXT + "\n\ndef a(x):\n    if x > 2:\n        return x - 1\n    return None", False),
        (TEXT + "\n\nThe form cut my entry to this:\n    We moved the pu\n\nYours,\nAnna", False),
        (TEXT[:-9], True),
        (TEXT[:-3] + " \n\n", True),
        (TEXT + " There is a copy at http://files.test/arc", True),
        (TEXT + "\n\n-- \nAnna B", True),
        ("> " + TEXT.replace("\n", "\n> ")[:-6], True),
        ("会議では新しい計画について話し、来週までに修理することになりました。会議で", True),
    ],
)
def test_plain_endings(body, cut):
    assert at_limit(T.ending(HEAD + "\n" + body)[0]) == cut
    assert at_limit(T.ending("From x@y.test Mon Oct 4 05:15 2009\r\n" + (HEAD + "\n" + body).replace("\n", "\r\n"))[0]) == cut


def test_encoded_and_marked_up_parts():
    b64 = base64.encodebytes((TEXT * 3).encode()).decode()
    head = HEAD + "Content-Transfer-Encoding: base64\n\n"
    assert T.ending(head + b64)[0] == "whole"
    assert all(T.ending(head + b64[:-k].rstrip())[0] == "cut" for k in (8, 9, 10, 11, 13))
    qp = HEAD + "Content-Transfer-Encoding: quoted-printable\n\nGr=C3=BC=C3=9Fe an alle im Haus, die Pumpe ist da"
    assert T.ending(qp + ".")[0] == "whole" and T.ending(qp + " f=C3")[0] == "cut" and T.ending(qp + " f=")[0] == "cut" and T.ending(qp)[0] == "cut"
    page = "Subject: x\nContent-Type: text/html\n\n<html><body>\n<p>Hello.</p>\n</body></html>\n"
    assert T.ending(page)[0] == "whole" and T.ending(page[:-9])[0] == "cut"
    multi = 'Subject: x\nContent-Type: multipart/mixed;\n boundary="=_q"\n\n--=_q\nContent-Type: text/plain\n\nHello.\n--=_q--\n'
    assert T.ending(multi)[0] == "whole" and T.ending(multi[:-4])[0] == "cut"


@pytest.mark.parametrize("s", ["", "a", "a\nb", "a\r\nb\r\n", "<é> & \"日本\" '\U0001f600'\t\\", "x" * 5000])
def test_lengths_are_those_of_the_stored_forms(s):
    lf, crlf = s.replace("\r\n", "\n"), re.sub(r"\r?\n", "\r\n", s)
    e = html.escape(s)
    # html.escape writes &#x27; for the apostrophe and &quot; for the quote: six characters each, five more than the sign.
    want = [len(s), len(s.encode()), len(s.encode("utf-16-le")) // 2, len(s.encode("latin-1", "replace")), len(lf), len(lf.encode()), len(crlf), len(crlf.encode()), len(e), len(e.encode()), len(json.dumps(s, ensure_ascii=False)) - 2, len(json.dumps(s, ensure_ascii=False).encode()) - 2, len(json.dumps(s)) - 2]
    assert T.lengths(s) == want


def message(i, n):
    rng = random.Random(i * 1009 + n)
    body = HEAD + "\n"
    while len(body) < n:
        body += f"Sentence number {rng.randrange(10**rng.randrange(1, 9))} says that {'the pump, ' * rng.randrange(4)}the lid is where it was.\n"
    return body


def test_limits_and_rates(spark):
    rows = [(i, "store", message(i, 900)[:600]) for i in range(40)] + [(100 + i, "store", message(i, 250 + 7 * i)) for i in range(40)]
    rows += [(200 + i, "free", message(i, 300 + 13 * i)) for i in range(60)] + [(300, None, None), (301, "free", ""), (302, "free", " \n"), (303, None, "x" * 100_000 + ".")]
    rows += [(400 + i, "free", HEAD + f"\nSentence {i} is here.\n\nNothing to add here\n\nBest wishes,\nAnna") for i in range(3)] + [(410, "free", HEAD + "\nHello.\n\nNothing to add here")]
    rows += rows[:1]
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], "doc_id int, source string, text string, lengths int, verdict string")
    judged, limits = T.judge(df)
    assert {(r.source, r.length) for r in limits.collect() if r.measure == "chars"} == {("store", 600)}
    got = {r.doc_id for r in judged.filter("truncated").collect()}
    whole = {i for i, s, t in rows[:40] if re.search(r"was\.$", t.rstrip())}
    assert got == set(range(40)) - whole
    rate = {r.source: r for r in T.rates(judged).collect()}
    assert rate["store"].n == 81 and rate["free"].n_truncated == 0 and rate[None].n == 1
    assert T.judge(df.limit(0))[0].count() == 0


def stored(n, seed, tail):
    """A message of exactly n characters that ends with `tail`."""
    rng = random.Random(seed)
    body = HEAD + f"\nSentence {rng.randrange(10**6)} says where it is.\n"
    fill = n - len(body) - len(tail) - 3
    return body + "lid " * (fill // 4) + "x" * (fill % 4) + ".\n\n" + tail


def test_the_limit_decides_endings_that_can_be_either(spark):
    tails = [f"Walk {w}" for w in "abcdefghijklmnopqrst"]
    rows = [(i, "store", stored(700, i, t)) for i, t in enumerate(tails)]
    assert {len(t) for _, _, t in rows} == {700} and all(T.ending(t)[0] == "ask" for _, _, t in rows)
    rows += [(100 + i, "free", stored(650 + 11 * i, i, t)) for i, t in enumerate(tails)]
    judged, limits = T.judge(spark.createDataFrame(rows, "doc_id int, source string, text string"))
    assert [(r.source, r.measure, r.length) for r in limits.collect()] == [("store", "chars", 700)]
    # The same endings: cut where the source has a limit and the text is at it, whole where not.
    assert {r.doc_id for r in judged.filter("truncated").collect()} == set(range(20))


def test_a_limit_on_escaped_length_counts(spark):
    def escaped(i):
        s = HEAD + "\n" + "a & b <c> \"d\" " * (i % 7) + f"Line {i} of it. "
        while T.lengths(s)[MEASURE] < 900:
            s += "x"
        return s

    MEASURE = T.MEASURES.index("html_chars")
    rows = [(i, "web", escaped(i)) for i in range(60)] + [(100 + i, "web", message(i, 300 + 17 * i)) for i in range(40)]
    judged, limits = T.judge(spark.createDataFrame(rows, "doc_id int, source string, text string"))
    assert [(r.measure, r.length) for r in limits.collect()] == [("html_chars", 900)]
    assert {r.doc_id for r in judged.filter("at_limit").collect()} >= set(range(60))


def test_a_remark_is_judged_by_texts_that_share_its_words_only(spark):
    alone = [(1, "a", HEAD + "\nHello.\n\nGreat work everyone")]
    other = [(2, "b", HEAD + "\nWe moved the pump. Please send the list to me. There is a lid on it.")]
    opens = [(3, "c", HEAD + "\nWe moved the pump. Great work is never done by one alone.")]
    ask = lambda rows: {r.doc_id for r in T.judge(spark.createDataFrame(rows, "doc_id int, source string, text string"))[0].filter("truncated").collect()}
    assert ask(alone) == set() and ask(alone + other) == set() and ask(alone + opens) == {1}
    said = [(10 + i, "d", HEAD + f"\nHello {i}.\n\nGreat work everyone\n\nYours,\nAnna") for i in range(2)]
    assert ask(alone + opens + said) == set()

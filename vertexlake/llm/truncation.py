"""Texts that were cut off by a length limit or in transfer, and how often each source does so.

Lengths: a text that was stored in a field of limited size has that size as its length - under the encoding and the
escaping in use when it was stored. So each text's length is computed again in code points, UTF-8 bytes, UTF-16 units
and Latin-1 bytes, as stored and with all line ends as LF or as CRLF, bare, with HTML entities and with JSON escapes.
Distinct texts are counted by source, measure and length; a length that far more texts have than have the lengths around
it is a candidate. A text at several candidates is explained by the one that stands out most, and a candidate that still
stands out by the texts it alone explains is a hidden limit of that source (`limits`), whatever its measure.

Endings: the end of a text is looked at the way its message is built. A multipart message is complete with its last
boundary, an HTML page with its last tag, encoded parts with whole groups. Of plain text the last line decides: a sentence mark, a name below a closing or
a signature line, a link, a table row or an emoji is an end; running text that breaks off is not. Where an ending can be
either, the limit decides: a text at a limit was cut, another one was not.

A short line without a full stop can be a remark or the opening of a sentence. It is a remark if it stands as a whole
paragraph before the end of another text; else a text at a limit was cut in it, and one that is not at a limit was cut (in
transfer) only if running text elsewhere opens a sentence with the same two words. Without any such trace it is a remark, so
no verdict depends on texts that share neither words nor source with it.

Cases: null, empty and blank texts are never found; a null source is a source of its own; texts of one line, without
headers, and very long texts are judged by the same rules; ids may repeat (each row is judged by itself, a repeated id with
one truncated row is reported once).
"""

from __future__ import annotations

import base64
import quopri
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.session import attach, broadcast_if_small, cut

#: A limit is held by at least so many texts of its source, and by so many times the mean of the 20 lengths around it.
LEAST, TIMES = 4, 8
#: Words of a remark, at most.
REMARK_WORDS = 6

MEASURES = ("chars", "utf8", "utf16", "latin1", "lf_chars", "lf_utf8", "crlf_chars", "crlf_utf8", "html_chars", "html_utf8", "json_chars", "json_utf8", "json_ascii")

_TERM = re.compile(r"""[.!?。！？…‽][)\]"'”»’）」]*$""")
_QUOTE = re.compile(r"^(?:> ?)+")
_LINK = re.compile(r"(?:https?|ftp)://\S*$")
_BLOCK = re.compile(r"\(.*\).*[:{]$")
_NAME = re.compile(r"[^\W\d_][\w'’.-]*(?: [^\W\d_][\w'’.-]*){0,3}")
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;"]+))', re.I)
_HEADER = re.compile(r"\A(?:From \S+ .*\n|>?[A-Za-z][\w-]*:.*\n?)(?:[ \t].*\n?)*(?:[A-Za-z][\w-]*:|\Z)")


def lengths(s: str) -> list[int]:
    """The length of a text under every measure, in the order of MEASURES."""
    n, b = len(s), len(s.encode("utf-8", "surrogatepass"))
    high = 0 if n == b else len(s.encode("utf-16-le", "surrogatepass")) // 2 - n
    crlf = s.count("\r\n")
    lone = s.count("\n") - crlf
    html = 4 * s.count("&") + 3 * (s.count("<") + s.count(">")) + 5 * (s.count('"') + s.count("'"))
    esc = s.count('"') + s.count("\\") + s.count("\n") + s.count("\r") + s.count("\t")
    ascii_ = n if n == b else len(s.encode("ascii", "ignore"))
    return [n, b, n + high, n, n - crlf, b - crlf, n + lone, b + lone, n + html, b + html, n + esc, b + esc, n + esc + 5 * (n - ascii_) + 6 * high]


def _lines(body: str) -> list[str]:
    """The lines of a text without marks of quotation and without blank lines at the end."""
    out = [_QUOTE.sub("", x).rstrip() for x in body.rstrip().split("\n")]
    while out and not out[-1].strip():
        out.pop()
    return out


def _paragraph(lines: list[str], end: int) -> list[str]:
    """The lines of the paragraph that ends before line number `end`."""
    a = end
    while a and lines[a - 1].strip() not in ("", "--"):
        a -= 1
    return [x.strip() for x in lines[a:end]]


def _plain_end(body: str, writer: str) -> tuple[str, str]:
    """(verdict, line): 'whole', 'cut', or 'ask' with the line that could be a remark; 'edge' is whole unless at a limit."""
    lines = _lines(body)
    if not lines:
        return "edge", ""
    last = lines[-1].strip()
    if _TERM.search(last) or ord(last[-1]) >= 0x1F000 or 0x2600 <= ord(last[-1]) <= 0x27BF or 0xFE00 <= ord(last[-1]) <= 0xFE0F:
        return "whole", ""
    para = _paragraph(lines, len(lines))
    above = lines[len(lines) - len(para) - 1].strip() if len(para) < len(lines) else None
    if above == "--":  # a signature of a few short lines
        return ("edge" if _open_detail(last) or len(para) == 1 and writer != last and writer.startswith(last) else "whole"), ""
    if _LINK.search(last):
        tail = last[last.rindex("://") + 3 :]
        if _LINK.fullmatch(last) and (len(para) == 1 or not _sentence(para[:-1])):
            return ("edge" if "/" not in tail or tail.endswith("/") else "whole"), ""
        return ("cut" if _sentence(para) and "." not in " ".join(para).rsplit("://", 1)[0].strip()[-1:] else "edge"), ""
    if "\t" in last:
        rows = [x for x in para if "\t" in x]
        same = len(rows) < 2 or (last.count("\t") == rows[-2].count("\t") and len(last.rsplit("\t", 1)[1]) >= len(rows[-2].rsplit("\t", 1)[1]) - (not last[-1].isdigit()))
        return ("whole" if same else "edge"), ""
    raw = _QUOTE.sub("", body.rstrip().split("\n")[-1])
    if raw[:1] in " \t" and len(para) > 1 and _BLOCK.search(para[0]):  # an indented block
        return ("whole" if len(last.split()) <= 4 or last.endswith((";", ")", "}", "]")) else "edge"), ""
    if re.fullmatch(r"[*\-•+] .{1,60}|\d+[.)] .{1,60}", last) and not _sentence([last[2:].strip()]):
        return "whole", ""
    if len(para) == 2 and len(para[0]) <= 40 and _closing(para[0]) and _NAME.fullmatch(last) and len(last.split()) <= 2:
        first = writer.split(" ")[0] if writer else ""
        return ("edge" if first and first != last and first.startswith(last) else "whole"), ""
    if last.endswith((")", "]", "}", "*", "_", "=", "-")) and len(para) == 1:
        return "whole", ""
    if len(para) == 1 and len(last.split()) <= REMARK_WORDS + 2:
        if last.startswith(("/", "-", "~")) or (last[0].islower() and last[0].isascii()) or not re.search(r"[^\W\d_]", last):
            return "whole", ""
        if last.endswith((",", ":")):
            return ("edge" if len(last.split()) <= 4 and _closing(last.replace(":", ",")) else "cut"), ""
        if len(last.split()) <= REMARK_WORDS and last[0].isascii():
            return "ask", last
    return "cut", ""


def _closing(line: str) -> bool:
    """Whether a line reads as a closing: a few words, no digits, no mark but a comma at its end."""
    return bool(re.fullmatch(r"[^\W\d_]+(?: [^\W\d_]+){0,4}[,.!。、!]?", line))


def _sentence(para: list[str]) -> bool:
    """Whether lines read as running text."""
    return len(" ".join(para).split()) > 4


def _open_detail(last: str) -> bool:
    """Whether a line of a signature is left open: a bracket without its mate, or a mark that joins."""
    return last.count("(") != last.count(")") or last.endswith(("(", "+", ",", "/", ":"))


def _unfold(head: str) -> str:
    return re.sub(r"\n[ \t]+", " ", head)


def ending(s: str) -> tuple[str, str]:
    """As `_plain_end`, of a whole message."""
    u = s.replace("\r\n", "\n")
    head, gap, body = u.partition("\n\n")
    if not gap and _HEADER.match(u):
        return "edge", ""  # headers only
    if not _HEADER.match(head):
        head, body = "", u
    flat = _unfold(head)
    low = flat.lower()
    m = re.search(r"^from:\s*\"?([^<\"\n]*)", flat, re.I | re.M)
    writer = m[1].strip() if m else ""
    if "multipart/" in low:
        b = _BOUNDARY.search(flat)
        if b:
            mark = f"--{b[1] or b[2]}--"
            if mark not in body:
                return "cut", ""
            rest = body[body.rindex(mark) + len(mark) :]
            return ("whole", "") if not rest.strip() else _plain_end(rest, writer)
    if not body.strip():
        return "edge", ""
    coding = re.search(r"^content-transfer-encoding:\s*([\w-]+)", low, re.M)
    coding = coding[1] if coding else ""
    end = body.rstrip()
    if coding == "base64":
        raw = re.sub(r"\s+", "", end)
        if len(raw) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", raw):
            return "cut", ""
        if raw.endswith("="):
            return "whole", ""
        try:
            data = base64.b64decode(raw)
            end = data.decode("utf-8")
        except ValueError:
            return "cut", ""
        end = end.replace("\r\n", "\n")
    elif coding == "quoted-printable":
        if re.search(r"=[0-9A-Fa-f]?$", end):
            return "cut", ""
        data = quopri.decodestring(end.encode("utf-8", "replace"))
        try:
            end = data.decode("utf-8")
        except UnicodeDecodeError as e:
            if e.end >= len(data) - 1 and e.reason == "unexpected end of data":
                return "cut", ""
            end = data.decode("latin-1")
    if "text/html" in low or re.match(r"\s*(?:<!doctype html|<html)", end, re.I):
        if re.search(r"<html\b", end, re.I):
            return ("whole" if re.search(r"</html\s*>\s*$", end, re.I) else "cut"), ""
        if re.search(r"<[^<>]*$", end) or not end.endswith(">"):
            return ("cut" if re.search(r"<[^<>]*$", end) else "edge"), ""
        return "whole", ""
    if end.endswith("�"):
        return "cut", ""
    return _plain_end(end, writer)


def _remarks(s: str) -> list[str]:
    """The one-line paragraphs without a sentence mark that stand before the end of a text."""
    if "\n" not in s:
        return []
    lines = [_QUOTE.sub("", x).strip() for x in s.replace("\r\n", "\n").rstrip().split("\n")]
    out = []
    for a, b, c in zip(lines, lines[1:], lines[2:]):
        if b and not a and not c and len(b) <= 60 and b[0].isupper() and not _TERM.search(b) and b[-1] not in ",:;>-" and len(b.split()) <= REMARK_WORDS:
            out.append(b)
    return out


_OPENING = re.compile(r"""[.!?…]["'”»)]?(?: +|\n)(?:> ?)*([^\W\d_>][^\s>]*)[ \n]+(?:> ?)*([^\s>]+)""")


_RUNNING = re.compile(r"\n(?:> ?)*\n(?:> ?)*([^\W\d_>][^\s>]*) ([^\s>]+)(?: [^\s>]+){6}")


def _openings(s: str) -> list[str]:
    """The first word, and the first two, of sentences that follow another one, and of paragraphs that begin with more words than a remark has."""
    u = s.replace("\r\n", "\n")
    found = {*_OPENING.findall(u), *_RUNNING.findall(u)}
    return sorted({a for a, _ in found} | {f"{a} {b}" for a, b in found})


def opening_of(line: str) -> str | None:
    """The words of a line by which it is looked for among the openings: the first two unless the second, which may be broken, is its last."""
    w = line.split()
    return None if not w else w[0] if len(w) <= 2 else f"{w[0]} {w[1]}"


_EXAMINED = "doc_id bigint, source string, same bigint, lengths array<int>, verdict string, line string, opening string, remarks array<string>, openings array<string>"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
_NAMES = [x.split(" ")[0] for x in _EXAMINED.split(", ")]


def examine(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, same, lengths, verdict, line, opening, remarks, openings) of every text that is neither null nor blank; `same` is equal for equal texts."""
    rows = df.filter(F.col(text).isNotNull()).select(F.col(id_).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("same"), F.col(text).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _TYPES]
            for i, src, same, s in zip(*[b.column(c).to_pylist() for c in ("doc_id", "source", "same", "text_")]):
                if not s.strip():
                    continue
                verdict, line = ending(s)
                for to, v in zip(out, (i, src, same, lengths(s), verdict, line, opening_of(line), _remarks(s), _openings(s))):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _TYPES)], _NAMES)

    return rows.mapInArrow(run, _EXAMINED)


def limits(examined: DataFrame) -> DataFrame:
    """(source, measure, length, n, around, own): the hidden limits of each source; a null source is one.

    n counts the distinct texts of that length, around the mean of the 20 lengths around it, own the texts that no
    limit which stands out more explains.
    """
    place = F.posexplode("lengths").alias("m", "length")
    each = examined.groupBy("source", "same").agg(F.min("lengths").alias("lengths")).withColumn("source_", F.coalesce("source", F.lit("\x01"))).select("source_", "same", place)
    n = each.groupBy("source_", "m", "length").agg(F.count("*").alias("n"))
    # The counts of a source and measure: as many rows as there are distinct lengths.
    w = Window.partitionBy("source_", "m").orderBy("length").rangeBetween(-10, 10)
    n = n.withColumn("around", (F.sum("n").over(w) - F.col("n")) / 20)
    peaks = cut(n.filter(_stands_out(F.col("n"))))
    at = attach(each, peaks, ["source_", "m", "length"], ["same"])
    first = F.max_by(F.struct("m", "length"), F.struct(F.col("n") - F.col("around"), -F.col("m"))).alias("p")
    own = at.groupBy("source_", "same").agg(first).groupBy("source_", "p.m", "p.length").agg(F.count("*").alias("own"))
    found = peaks.join(own, ["source_", "m", "length"]).filter(_stands_out(F.col("own")))
    return found.select(F.nullif("source_", F.lit("\x01")).alias("source"), F.array(*map(F.lit, MEASURES))[F.col("m")].alias("measure"), "length", "n", "around", "own")


def _stands_out(n: Column) -> Column:
    return (n >= LEAST) & (n > TIMES * F.col("around") + LEAST)


def judge(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, at_limit, verdict, truncated) of every text that is neither null nor blank, and the limits."""
    x = cut(examine(df, id_, text, source))
    found = cut(limits(x))
    # A byte limit that falls inside a character leaves up to three bytes less.
    reach = found.withColumn("length", F.explode(F.when(F.col("measure").endswith("utf8"), F.sequence(F.col("length") - 3, F.col("length"))).otherwise(F.array("length"))))
    reach = reach.select(F.coalesce("source", F.lit("\x01")).alias("source_"), (F.array_position(F.array(*map(F.lit, MEASURES)), F.col("measure")) - 1).cast("int").alias("m"), F.col("length").cast("int").alias("length")).distinct()
    reach = reach.groupBy("source_").agg(F.collect_set(F.struct("m", "length")).alias("ends"))  # a source's limits: a few
    y = x.select("doc_id", "source", "lengths", "verdict", "line", "opening", F.coalesce("source", F.lit("\x01")).alias("source_"))
    y = attach(y, reach, ["source_"], ["doc_id"], how="left").withColumn("at_limit", F.coalesce(F.exists("ends", lambda e: F.col("lengths")[e["m"]] == e["length"]), F.lit(False)))
    y = y.select("doc_id", "source", "at_limit", "verdict", "line", "opening")
    asked = cut(y.filter("verdict = 'ask'"))
    lines, openings = (asked.select(c).filter(F.col(c).isNotNull()).distinct() for c in ("line", "opening"))
    known = broadcast_if_small(lines)[0]
    known = x.select(F.explode("remarks").alias("line")).join(known, "line").groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line", F.lit(True).alias("remark"))
    opens = broadcast_if_small(openings)[0]
    opens = x.select(F.explode("openings").alias("opening")).join(opens, "opening").distinct().withColumn("opens", F.lit(True))
    asked = attach(attach(asked, known, ["line"], ["doc_id"], how="left"), opens, ["opening"], ["doc_id"], how="left")
    asked = asked.withColumn("truncated", F.col("remark").isNull() & (F.col("at_limit") | F.col("opens").isNotNull()))
    sure = y.filter("verdict <> 'ask'").withColumn("truncated", (F.col("verdict") == "cut") | ((F.col("verdict") == "edge") & F.col("at_limit")))
    out = sure.unionByName(asked.select(*sure.columns))
    return out.select("doc_id", "source", "at_limit", "verdict", "truncated"), found


def rates(judged: DataFrame) -> DataFrame:
    """(source, n, n_truncated, n_at_limit, rate): the share of truncated texts of each source."""
    t = F.sum(F.col("truncated").cast("bigint"))
    return judged.groupBy("source").agg(F.count("*").alias("n"), t.alias("n_truncated"), F.sum(F.col("at_limit").cast("bigint")).alias("n_at_limit"), (t / F.count("*")).alias("rate"))

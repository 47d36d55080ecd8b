import hashlib
import json
import math

import pytest
from graphloom.llm import chat_format as C
from graphloom.llm.token_counts import encoding
from same import assert_same

DDL = "conv_id long, turn long, role string, text string, prompt string, turns string, part string, segment string, pieces string, at string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["own"] * 6) for r in rows], DDL)


def brute(turns, segment=C.SEGMENT):
    """The whole format for one conversation, turn by turn: segment -> (prompt, turns, tokens, refs)."""
    out, number, chars = {}, 0, 0
    role_of = lambda r: r if r in C.ROLES else "user"
    for turn, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, role_of(t[1]), t[2] is not None, hashlib.md5((t[2] or "").encode()).hexdigest())):
        given = None
        try:
            given = json.loads(text or "")
        except (ValueError, RecursionError):
            pass
        if not (isinstance(given, list) and given and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in given)):
            given = [{"type": "text", "text": text}]
        shown, tokens, refs, size = "", 0, [], 0
        for p in given:
            kind = p["type"]
            if kind == "text":
                own = p.get("text") or ""
                shown, n, size = shown + own, len(encoding().encode_ordinary(own)), size + len(own)
            else:
                number += 1
                label = kind if kind in ("image", "audio", "document") else "part"
                shown, size = f"{shown}<{label}:{number}>", size + len(label)
                good = lambda k: p[k] if isinstance(p.get(k), (int, float)) and p[k] > 0 else 0  # noqa: B023, E731
                n = {"image": math.ceil(good("width") / 28) * math.ceil(good("height") / 28) or 256, "audio": math.ceil(good("seconds") * 25), "document": (good("pages") or 1) * 512, "part": 0}[label]
                refs.append((number, kind, json.dumps(p) if label == "part" else p.get("url"), turn, n))
            tokens += n
        own = out.setdefault(chars // segment, ["", 0, 0, []])
        own[0] += f"<|{role_of(role)}|>\n{shown}<|end|>\n"
        own[1] += 1
        own[2] += tokens
        own[3] += refs
        chars += size
    return out


def run(spark, rows, segment=C.SEGMENT, parts=3):
    got = {}
    for r in C.format_chats(table(spark, rows).repartition(parts), segment=segment).collect():
        got.setdefault(r.conv_id, {})[r.segment] = [r.prompt, r.n_turns, r.n_tokens, [tuple(a) for a in r.attachments]]
    return got


def want(rows, segment=C.SEGMENT):
    by = {}
    for c, *t in rows:
        by.setdefault(c, []).append(tuple(t))
    return {c: brute(t, segment) for c, t in by.items()}


MIXED = json.dumps([
    {"type": "text", "text": "Look: "}, {"type": "image", "url": "s3://a.png", "width": 57, "height": 28}, {"type": "audio", "url": "b.wav", "seconds": 1.5}, {"type": "text"},
    {"type": "document", "url": "c.pdf", "pages": 3}, {"type": "video", "url": "d.mp4"}, {"type": "image", "url": "e.png"},
])
ROWS = [
    (1, 0, "user", "Hi, you!"), (1, 1, "assistant", "Hello."), (2, 0, "user", MIXED), (2, 1, "user", MIXED), (2, 2, "assistant", "two"), (3, 1, "odd", None), (3, None, None, ""), (3, 0, "tool", "[1, 2]"),
    (4, 0, "user", "[not json"), (4, 1, "user", '[{"text": "no type"}]'), (4, 2, "user", "[]"), (4, 3, "user", ' [{"type": "text", "text": "in"}] '), (4, 4, "user", '[{"type":"function"}] please explain'),
    (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "assistant", "same"), (5, 0, "user", "other"), (5, 0, "user", None),
    (6, 0, "user", json.dumps([{"type": "document", "pages": -2}, {"type": "image", "width": 0, "height": 9}, {"type": "document", "pages": 5_000_000}, {"type": "audio", "seconds": "long"}, {"type": "video"}])),
    (7, 0, "user", "w " * 200_000), *((8, i, "user", json.dumps([{"type": "image", "url": str(i)}])) for i in range(60)), (9, 0, "user", "<|end|> <image:1>"), (10, 0, "user", "[" * 100_000),
]


def test_against_brute_force(spark):
    assert run(spark, ROWS) == want(ROWS)


@pytest.mark.parametrize("segment", [C.SEGMENT, 900])
def test_a_conversation_over_many_partitions(spark, segment):
    """Most rows are of one conversation; its numbers go on from partition to partition."""
    rows = [(5, i, "user", MIXED if i % 3 == 0 else "words " * (i % 7)) for i in range(600)] + [(i, 0, "user", MIXED) for i in range(12)] + [(5, 7, "user", "the same")] * 9
    assert run(spark, rows, segment) == want(rows, segment)


def test_sizes_without_bounds(spark):
    huge = [{"type": "document", "pages": 10**30}, {"type": "image", "width": 1e300, "height": 1e300}, {"type": "audio", "seconds": 1e308}, {"type": "text", "text": {"a": "\ud800"}}]
    (got,) = run(spark, [(1, 0, "user", json.dumps(huge))]).values()
    assert [a[4] for a in got[0][3]] == [C.MOST] * 3 and "ud800" in got[0][0]


def test_rows_without_conversation_and_empty_tables(spark):
    assert run(spark, [(None, 0, "user", "lost")]) == {} and C.format_chats(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        C.format_chats(table(spark, []).drop("role"))


def test_all_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == want(rows)
    got = {(r.conv_id, r.segment): (r.prompt, r.n_turns, r.n_tokens) for r in C.op3(spark, sf_dir).collect()}
    assert got == {(c, s): tuple(x[:3]) for c, by in want(rows).items() for s, x in by.items()}


def test_typed_parts_against_sql(spark, duck, sf_dir):
    assert_same(C.typed_parts(spark, sf_dir), duck, C.SQL)

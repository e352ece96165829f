"""Fill-in-the-middle, conversation repair and chat formatting against brute force, and their defined results in odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat_format, conversation_repair, fill_middle

LETTERS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = [None, "", " ", "a", "ab cd", "ab\r\ncd\n", "<P>x", "x <S", "M><M", "<P", "😀b😀😀c d", "é1é ß", "word " * 30000, "x" * 50000, "ab cd", "a\nb\n", "\n\n", "no < marker > <p>"] + [f"some text {i}, with a middle." for i in range(60)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in ("units", "h", "n", "form", "prefix", "t", "turns", "parts", "formatted", "mask", "r", "gone", "kind", "copy", "part", "seq", "audit", "list", "of")})


# fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = LETTERS.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    p, m = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def test_fill_middle(spark):
    given = list(enumerate(TEXTS)) + [(None, "without an id"), (3, "a"), (3, "another text of one id")]
    df = clashing(spark.createDataFrame(given, "doc_id long, text string"))
    got = sorted((tuple(r) for r in fill_middle.digests(df).collect()), key=repr)
    assert got == sorted(((i, *brute_fim(i, t)) for i, t in given), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("units", "pattern"),
    [
        (fill_middle.LETTERS, r"[A-Za-z]+|[^A-Za-z]"),
        (fill_middle.CHARACTERS, r"[\s\S]"),
        (fill_middle.LINES, r"[^\n]*\n|[^\n]+"),
        (fill_middle.WORDS, r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"),
        (fill_middle.Units(runs=("A-Za-z", "0-9")), r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"),
    ],
)
def test_units(spark, units, pattern):
    texts = [t for t in TEXTS if t is not None and len(t) < 1000] + ["ab12 c3\n\td", "9😀9"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, pieces in df.select("text", fill_middle.pieces(F.col("text"), units)).collect():
        assert pieces == re.findall(pattern, text), text


# conversation repair


def brute_damage(rows):
    out, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, ids


def brute_report(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, symbols, seen = [0, 0, 0], [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        symbols.append((role[:1], fault in (0, 1), fault == 2))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    # the cheapest and then least audit from each place and state, and the turns that it gives
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}
    for i in range(len(rows), -1, -1):
        here = {}
        for q in after:
            options = []
            if i == len(rows):
                if q in ("", "a"):
                    options.append((0, "", ()))
            else:
                initial, gone, truncated = symbols[i]
                cost, audit, left = best[i + 1][q]
                options.append((cost + 3, "D" + audit, left))
                if not gone:
                    if initial in after[q]:
                        cost, audit, left = best[i + 1][after[q][initial]]
                        options.append((cost + truncated, "K" + audit, ((rows[i][2], rows[i][3]), *left)))
                    for name in ("user", "assistant"):
                        if name[0] in after[q]:
                            cost, audit, left = best[i + 1][after[q][name[0]]]
                            options.append((cost + 2 + truncated, "R" + audit, ((name, rows[i][3]), *left)))
            here[q] = options
        for _ in range(5):
            # with insertions, until nothing changes
            known = {q: min(o, key=lambda x: x[:2]) if o else None for q, o in here.items()}
            for q in after:
                for name in ("user", "assistant"):
                    if name[0] in after[q] and known[after[q][name[0]]]:
                        cost, audit, left = known[after[q][name[0]]]
                        here[q].append((cost + 2, "I" + audit, ((name, ""), *left)))
        best[i] = {q: min(o, key=lambda x: x[:2]) for q, o in here.items()}
    cost, audit, left = best[0][""]
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left))), left


def random_rows(n, rng, conversations=40):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "umpire"]
    texts = ["One.", "Two!", "Three", "four?", "", " \n", None, "five. ", "six ", "septé.", "x"]
    out = []
    for i in range(n):
        conv = rng.choice([None, *range(conversations)])
        turn = rng.choice([None, *range(12)]) if conv != 7 else i
        out.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"Text {rng.random()}."))
    return out


def check_repair(spark, rows, damage=True, **blocks):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = conversation_repair.damaged(df) if damage else conversation_repair.read_rows(df)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.reports(read, **blocks).collect()}
    kept, ids = brute_damage(rows) if damage else ([(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows], {r[0] for r in rows})
    assert set(got) == ids
    wanted = {c: brute_report([r for r in kept if r[0] == c]) for c in ids}
    assert got == {c: w[0] for c, w in wanted.items()}
    turns = {}
    for conv, i, role, text in conversation_repair.repaired(read, **blocks).collect():
        turns.setdefault(conv, []).append((i, role, text))
    assert {c: tuple(t) for c, (_, t) in wanted.items() if t} == {c: tuple((r, t) for _, r, t in sorted(v)) for c, v in turns.items()}


def test_repair(spark):
    check_repair(spark, random_rows(600, random.Random(1)))


@pytest.mark.parametrize("rows", [1, 3])
def test_repair_in_blocks(spark, rows):
    """Conversations of many blocks, repeats and one long one among them, come out as if they were whole."""
    rng = random.Random(rows)
    given = random_rows(250, rng, 8) + [(7, i % 60, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"So {i}."])) for i in range(200)]
    check_repair(spark, given, damage=False, block_rows=rows)


def test_repair_odd(spark):
    check_repair(spark, [(1, None, None, None), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (None, 5, "assistant", "A" * 100000 + "."), (None, None, "system", "S.")])
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversation_repair.reports(conversation_repair.damaged(empty)).collect() == []
    assert conversation_repair.repaired(conversation_repair.read_rows(empty)).collect() == []


def test_vectors_are_few():
    """The determinised automaton stays small, whatever it reads."""
    rng, repairs = random.Random(3), conversation_repair.Repairs()
    for _ in range(300):
        repairs.matrix(bytes(rng.choice(range(9)) for _ in range(40)))
    assert len(repairs.vectors) < 2000


# chat formatting


def test_chat_format(spark):
    rng = random.Random(5)
    bits = ["<|im_end|>", "<|im_sep|>", "<|im_start|>user\n", "<|", "<\\|", "<\\\\|", "|", "<", "\\", "\n", "text", "é😀", "\\n"]
    roles = ["user", "assistant", "system", "a\nb", "a\\nb", "<|im_end|>", "assistant\n", None, ""]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(roles), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for _ in range(500)]
    rows += [(1000, 0, "assistant", "x" * 300000), (1000, 1, "assistant", None), (1001, 3, "user", "same"), (1001, 3, "user", "same")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    wanted = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        wanted[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for *_, r, x in own)), len(loss), sha(loss))
    assert {r[0]: tuple(r)[1:5] for r in chat_format.digests(df).collect()} == wanted
    for _, formatted, mask in chat_format.format_conversations(df).collect():
        assert sum(m["before"] + m["loss"] + m["behind"] for m in mask) == len(formatted)
        # only the template's own control strings are left
        assert len(re.findall(r"<\|", formatted)) == len(re.findall(r"<\|im_(?:start|sep|end)\|>", formatted))
    assert chat_format.digests(df.limit(0)).collect() == []


def test_chat_merges_roles(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    (row,) = chat_format.format_conversations(df).collect()
    assert row["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [m["loss"] for m in row["mask"]] == [0, 0, 1]


def test_chat_without_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").select("*")
    plan = chat_format.digests(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

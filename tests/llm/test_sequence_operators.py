"""Packing, conversation repair and fill-in-middle, against brute force and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import fim, packing, queries, repair
from foldwise.llm.common import table, vocabulary_path
from tests.conftest import SF001, SF01
from tests.llm.test_text_operators import DOCS, ODD, nz

TURNS = "conv_id long, turn long, role string, text string"


# ---- 11: packing ----

def best_fit(lengths, capacity):
    """Sequences that sequential best-fit decreasing needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = min((g for g in gaps if g >= n), default=None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(at)
            gaps.append(at - n)
    return len(gaps)


def assert_gapless(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end and n > 0
            end = at + n
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("kind", ["even", "mid", "tiny", "thirds", "hot", "few"])
def test_rounds_pack_as_best_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "RUNS", 16)                 # many ranges, two levels of leftovers
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(kind)
    capacity = 128
    lengths = {"even": [rng.randint(1, 127) for _ in range(3000)], "mid": [rng.randint(20, 70) for _ in range(2000)],
               "tiny": [rng.randint(1, 9) for _ in range(3000)], "thirds": [rng.choice([43, 44, 41, 65, 81]) for _ in range(2000)],
               "hot": [rng.randint(1, 127) for _ in range(800)] + [30] * 4000, "few": [127]}[kind]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.fitted(spark.createDataFrame(sorted(counts.items()), "length long, n long"), capacity).collect()
    places, used = {}, set()
    for r in runs:
        for i in range(r.n):
            assert (r.size, r.first + i) not in used
            used.add((r.size, r.first + i))
            places.setdefault(r.bin + i // r.per, []).append((r.at + i % r.per * r.size, r.size))
    assert used == {(n, i) for n, k in counts.items() for i in range(k)}
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end = at + n
        assert end <= capacity
    fewest = best_fit(lengths, capacity)
    assert len(places) <= fewest + 1 + fewest // 100


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def test_pack_odd_rows(spark, library):
    rows = [*ODD, (11, "long " * 30_000)]
    odd = spark.createDataFrame(rows, DOCS).withColumns({"length": F.lit("x"), "n": F.lit(1), "sequence_id": F.lit(0.5), "bin": F.lit(2)})
    got = packing.pack(odd, vocabulary_path(), with_ids=True)
    found = got.collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(nz(d), k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes()), tuple(ids[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((nz(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found) == sorted(want)
    assert_gapless(found, 2048)
    made = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in made) == sum(r.length for r in found)
    for r in made:
        assert len(r.ids) <= 2048 and r.starts[0] == 0
    empty = packing.pack(odd.limit(0), vocabulary_path())
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_packed_documents(spark, library):
    docs = table(spark, SF001, "documents")
    found = queries.op11_packing(spark, SF001).collect()
    used = assert_gapless(found, 2048)
    lengths = {}
    for r in docs.collect():
        lengths[r.doc_id] = len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    total = {}
    for r in found:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == lengths
    assert used <= best_fit([r.length for r in found], 2048) + 1


def test_vocabulary_whose_merges_are_out_of_order(tmp_path):
    """Its ids come from the tokenizers library itself."""
    import json

    from pyspark import SparkFiles
    spec = json.load(open(vocabulary_path(), encoding="utf-8"))
    merges = spec["model"]["merges"]
    spec["model"]["merges"] = merges[1:] + merges[:1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    get, SparkFiles.get = SparkFiles.get, staticmethod(lambda name: str(path))
    try:
        from tokenizers import Tokenizer
        text = "the other thing <|endoftext|> there"
        assert packing._encode.__wrapped__("other").__call__(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    finally:
        SparkFiles.get = get


# ---- 12: conversation repair ----

SPACES = " \t\n\x0b\x0c\r"
START = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
NAMES = {"u": "user", "a": "assistant"}


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest()


def brute_repair(rows):
    """The contract's numbers of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=order)
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}

    def offer(to, state, cost, audit, lines):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = cost, audit, lines

    def inserted(best):
        for _ in range(4):
            for s, (cost, audit, lines) in list(best.items()):
                offer(best, START[s][DUE[s]], cost + 2, audit + "I", (*lines, NAMES[DUE[s]] + ":"))
        return best

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for s, (cost, audit, lines) in inserted(best).items():
            offer(after, s, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            cost += fault == "truncated"
            if role[:1] in START[s]:
                offer(after, START[s][role[:1]], cost, audit + "K", (*lines, f"{role}:{text}"))
            offer(after, START[s][DUE[s]], cost + 2, audit + "R", (*lines, f"{NAMES[DUE[s]]}:{text}"))
        best = after
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in (0, 3))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t, t // 2, None, t + 5])
            rows.append((c if c else None, turn, rng.choice(["user", "assistant"] * 4 + ["system", "s", "tool", "", " "]),
                         rng.choice(["Yes.", "No!", "cut", " \n", "", "x é.\n ", f"text {rng.randint(0, 9)}.", "why? "])))
    return rows


def brute_of(rows):
    by = {}
    for c, *r in rows:
        by.setdefault(nz(c), []).append(tuple(r))
    return {c: brute_repair(r) for c, r in by.items()}


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = conversations(block, 150, 12) + [(500, t, "user" if t % 3 else "assistant", f"t{t % 40}.") for t in range(300)]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit(1), "sha": F.lit("x"), "part": F.lit("y"), "state": F.lit(None).cast("int")})
    got = repair.digests(turns).collect()
    assert len(got) == len({nz(r[0]) for r in rows})
    assert {nz(r.conv_id): tuple(r)[1:] for r in got} == brute_of(rows)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_chain(block):
    """Blocks of a few rows, chained as the tasks chain them, against the brute force."""
    rng = random.Random(block)
    for _ in range(150):
        rows = sorted(((t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", "c!"])) for t in range(rng.randint(1, 14))), key=order)
        want = brute_repair(rows)
        codes, seen = bytearray(), set()
        for _, role, text in rows:
            code = repair.BLANK + repair.GOES if not text else repair.SEEN + repair.GOES if (role, text) in seen else repair.CUT * (text[-1] not in ".!?")
            codes.append(code + repair.initial_of(role))
            seen.add((role, text))
        parts = [bytes(codes[i:i + block]) for i in range(0, len(codes), block)]
        ahead = [np.array(repair.END_COST)]
        for m in reversed(repair.matrices(parts)):
            ahead.insert(0, np.minimum((m + ahead[0][:, None]).min(0), repair.FAR))
        found, exits = repair.audits(parts, np.array(ahead[1:]))
        state, audit = 0, ""
        for f, e in zip(found, exits):
            audit, state = audit + f[state], e[state]
        assert (int(ahead[0][0]), audit + repair.END_AUDIT[state]) == want[5:7]


def test_repair_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "So"), (2, 0, "assistant", None), (3, 7, "system", "Be.")]
    got = repair.repair(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "number", "place").collect()
    shown = {}
    for r in got:
        shown.setdefault(r.conv_id, []).append((r.edit, r.turn, r.old_role, r.role, r.text))
    assert shown[1] == [("K", 0, "user", "user", "Hi."), ("I", None, None, "assistant", ""), ("K", 1, "user", "user", "There."), ("K", 2, "assistant", "assistant", "So")]
    assert shown[2] == [("D", 0, "assistant", None, None)] and shown[3] == [("D", 7, "system", None, None)]
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0 and repair.digests(none).count() == 0


def test_repaired_query(spark):
    turns = table(spark, SF01, "conversations").collect()
    rows, want = [], {}
    for r in turns:
        want.setdefault(r.conv_id, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
        hit = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", r.text) if hit == 2 else r.text
        rows += [(r.conv_id, r.turn, "user" if hit == 4 else r.role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    want |= brute_of(rows)
    got = queries.op12_repair(spark, SF01).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_damage_of_nulls(spark):
    rows = [(None, None, None, None), (5, None, "user", "a."), (None, 3, None, "b.")]
    hits = [zlib.crc32(k) % 20 for k in (b" : ", b"5: ", b" :3")]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in repair.damaged(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {(c, t) for (c, t, _, _), h in zip(rows, hits) if h != 0}
    for (c, t, role, text), h in zip(rows, hits):
        if h > 4:
            assert got[c, t] == (role or " ", text or " ")


# ---- 13: fill-in-middle ----

def brute_fim(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    if h4 % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rotations_invert():
    rng = random.Random(2)
    for _ in range(300):
        a, b, c, d = (rng.randbytes(rng.randint(0, 9)) for _ in range(4))
        data = bytearray(a + b + c + d)
        fim.rotate(data, len(a), len(a + b), len(a + b + c))
        assert data == a + c + b + d
        fim.rotate(data, len(a), len(a + c), len(a + b + c))
        assert data == a + b + c + d


def test_fim_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "é", "\n", "<", "<P", ">", "P>", "<M", "中\n", "\r\n", "😀", "<S>"]
    rows = [*ODD, *((i, "".join(rng.choices(parts, [9] * 11 + [1], k=rng.randint(0, 25)))) for i in range(100, 900)), (2000, "line é\n" * 50_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"form": F.lit(1), "n": F.lit("x"), "c0": F.lit(2), "_doc": F.lit(3)})
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "c0", "_doc", "fim", "form", "n", "prefix_chars", "middle_chars"]
    got = made.collect()
    want = [(nz(d), *brute_fim(d, t or "")) for d, t in rows]
    found = [(nz(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.fim) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert fim.restore(r.fim.encode(), r.form).decode() == (r.text or "")
    sha = {nz(r.doc_id): (r.output_sha256, r.restored_sha256) for r in fim.digests(docs).collect()}
    for d, t in rows:
        if (d, t) != (4, "Same text"):
            assert sha[nz(d)] == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (brute_fim(d, t or "")[-1], t or ""))
    assert fim.digests(docs.limit(0)).count() == 0


def test_fim_rate(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], DOCS)
    forms = [r.form for r in fim.transform(docs, rate=50, spm=0).collect()]
    assert "spm" not in forms and 120 < forms.count("plain") < 280

from __future__ import annotations

import hashlib
import random

import pytest
import xxhash

from footfall.llm import order_minhash
from footfall.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS

K, SLOTS, BITS = order_minhash.K, order_minhash.SLOTS, order_minhash.PLACE_BITS


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def digest(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed=seed)


def number(n: int, width: int, seed: int) -> int:
    return digest(n.to_bytes(width, "little", signed=True), seed)


def brute_slots(text: str | None) -> list[int]:
    wide = (text or "").encode("utf-16-be")
    kmers = [signed(digest(wide[2 * i : 2 * (i + K)])) >> BITS for i in range(max(len(wide) // 2 - K, 0) + 1)]
    seen: dict[int, int] = {}
    ring = []
    for place, kmer in enumerate(kmers):
        again = seen.get(kmer, 0)
        seen[kmer] = again + 1
        at = signed(number(again, 4, number(kmer, 8, 42))) >> BITS if again else kmer
        ring.append((at << BITS) | place)
    ring.sort()
    slots = []
    for j in range(SLOTS):
        start = -(1 << 63) + j * (1 << 64) // SLOTS
        first = sum(x < start for x in ring)
        picked = sorted(ring[(first + t) % len(ring)] & ((1 << BITS) - 1) for t in range(min(order_minhash.TUPLE, len(ring))))
        value = 42
        for place in picked:
            value = number(kmers[place], 8, value)
        slots.append(value & 0xFFFFFFFF)
    return slots


def brute_rows(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    rows = [(k, t or "") for k, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(digest(r[1].encode()))))
    out = []
    for at, (key, text) in enumerate(rows):
        other = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = brute_slots(text), brute_slots(edited), brute_slots(other)
        alike = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / SLOTS
        out.append((
            key, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a),
            "".join(f"{x:08x}" for x in b), alike(a, b), alike(a, c),
        ))
    return out


def as_set(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


@pytest.fixture(scope="module")
def small_texts():
    long = [(d, t if t is None else t[:3_000]) for d, t in ODD_TEXTS]
    rng = random.Random(3)
    made = [(20 + i, "".join(rng.choice("abc é日🎉") for _ in range(rng.randrange(40)))) for i in range(40)]
    return [*long, *made, (5, "another text of the same key"), (6, ODD_TEXTS[6][1]), (21, made[0][1]), (21, made[1][1])]


@pytest.mark.parametrize("range_rows", [1_024, 3])
def test_against_brute_force(spark, docs_of, small_texts, monkeypatch, range_rows):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", range_rows)
    df = order_minhash.edit_comparison(docs_of(small_texts).repartition(3))
    assert as_set(df.collect()) == as_set(brute_rows(small_texts))


@pytest.mark.parametrize("near_bits", [(3, 7), (1, 2), ()])
def test_numbers_of_repeated_kmers(docs_of, monkeypatch, near_bits):
    monkeypatch.setattr(order_minhash, "NEAR_BITS", near_bits)
    # So many occurrences that the search of each reach, and the one of all, meets its first and last number.
    rows = [(n, "0123456789abcdef"[: 1 + n % 16] * n + "end of a text") for n in (*range(1, 16), 129, 130, 131, 132, 133, 300)]
    rows += [(1_000 + n, "x" * (K + n)) for n in (0, 1, 2, 3, 9, 10, 11, 129, 130, 131, 132, 300)]
    got = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs_of(rows)).collect()}
    assert got == {key: "".join(f"{x:08x}" for x in brute_slots(text)) for key, text in rows}


def test_near_repeats_are_searched_first(docs_of):
    plan = order_minhash.fingerprints(docs_of([(1, "a text")]))._jdf.queryExecution().optimizedPlan().toString()
    # Not only the powers of two of the whole distance, which are made anew for each k-mer.
    assert "[4,2,1]" in plan and "[64,32,16,8,4,2,1]" in plan


def test_single_row_and_empty_table(docs_of):
    one = order_minhash.edit_comparison(docs_of([(7, "only one text here")])).first()
    assert one.near_next == 1.0 and one.doc_id == 7
    assert order_minhash.edit_comparison(docs_of([])).collect() == []
    assert order_minhash.fingerprints(docs_of([])).collect() == []


def test_very_long_texts(docs_of):
    rows = [(1, "a" * 70_000), (2, "word " * 30_000), (3, "日本語テキスト" * 5_000)]
    got = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs_of(rows)).collect()}
    # Repeated k-mers are numbered, so even these rings hold one element for each place.
    assert len(set(got.values())) == 3
    assert got[3] == "".join(f"{x:08x}" for x in brute_slots(rows[2][1]))


def test_order_and_edits_show(docs_of):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    text = " ".join(words)
    edited = text.replace(words[40], "xyz")
    moved = " ".join(words[150:] + words[:150])
    shuffled = " ".join(rng.sample(words, len(words)))
    rows = dict(enumerate([text, edited, moved, shuffled, text]))
    got = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs_of(list(rows.items()))).collect()}

    def near(a, b):
        return sum(got[a][i : i + 8] == got[b][i : i + 8] for i in range(0, 8 * SLOTS, 8)) / SLOTS

    assert got[0] == got[4]
    assert near(0, 1) > 0.85
    # The same k-mers in another order: a plain set sketch would hardly tell them apart.
    assert near(0, 2) < near(0, 1) - 0.2
    assert near(0, 3) < 0.1


def test_query_without_python_workers(spark, testdata):
    df = QUERIES["op13_order_minhash"](spark, f"{testdata}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{testdata}/sf0.001/documents.parquet").collect()]
    kept = [r for r in docs if len(r[1] or "") < 2_000]
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(docs)
    for key, text in kept[:40]:
        assert got[key].fingerprint == "".join(f"{x:08x}" for x in brute_slots(text))

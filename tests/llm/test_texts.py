"""Quality, BPE, personal data and secrets against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from footfall.llm import bpe, crf, pii, quality, secrets
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(testdata):
    import duckdb

    return [r[0] for r in duckdb.execute(f"select text from '{testdata}/sf0.001/documents.parquet'").fetchall()]


def random_texts(letters: str, n: int, longest: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


# ---- quality ----


def test_base_counts(texts):
    for text in [*texts, *(t for _, t in ODD_TEXTS if len(t or "") < 5000), *random_texts("ab \n\t#|", 300, 80, 1)]:
        assert quality.judge(text)[:6] == brute.quality_base(text)


def test_line_rules():
    prose = "This line is plain prose and ends as it should."
    second = "Another sentence of its own follows here with more to say."
    assert quality.judge(f"{prose}\n{second}")[6]
    # Two lines that differ in one word repeat 12 of 20 words in windows of five, which the base rule rejects.
    assert not quality.judge("\n".join([prose, prose.replace("plain", "other")]))[6]
    for junk in ("A | b | c | d | e | f | g | h | i | j | k", "WE!! SHOUT!! ALL!! OF!! THIS!! LINE!! HERE!! AND!! ON!! ON!!",
                 "so### much%%% noise&&& in*** this$$$ line### that&&& it%%% goes### away&&&"):
        assert not quality.judge(junk)[6]
        figures = quality.judge(f"{prose}\n{junk}\n{second}")
        assert figures[6] and figures[8] == 1 and junk not in figures[11]
    with_notice = quality.judge(f"{prose}\nAll rights reserved.")
    assert with_notice[6] and with_notice[11] == prose


def test_labels_agree(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{testdata}/sf0.01/labels.parquet")
    rows = quality.line_first(docs, with_text=False).join(labels, "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert right >= 0.97 * len(rows)


def test_quality_rows(docs_of):
    rows = {r.doc_id: r for r in quality.line_first(docs_of(ODD_TEXTS)).collect()}
    assert len(rows) == len(ODD_TEXTS)
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept and rows[0].clean_text == ""
    kept = quality.keep_documents(docs_of([*ODD_TEXTS, ODD_TEXTS[5]]))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5, 5, 6]
    assert quality.line_first(docs_of([])).count() == 0


# ---- BPE ----


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)


def test_ids_and_decoding_are_the_library_s(texts, library):
    model = bpe.load(VOCABULARY)
    odd = [t or "" for _, t in ODD_TEXTS] + ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b"]
    odd += random_texts("ab' \n\t\xa0é1²!日　 \x85\x1c's're'LL", 400, 120, 2)
    odd += [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in range(0, 0x110000, 211) if not 0xD800 <= c < 0xE000]
    every = [*texts, *odd]
    for packed, want in zip(model.encode_packed(every), library.encode_batch(every, add_special_tokens=False), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == want.ids
        assert model.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_both_trees_agree():
    model = bpe.load(VOCABULARY)
    pieces = [p.encode() for p in random_texts("thereandstionwé", 300, 60, 3) if p and len(p.encode()) <= bpe.WIDEST]
    for piece in pieces:
        assert np.frombuffer(model.encode_short([piece])[0], "<u4").tolist() == model.encode_long(piece)


def test_broken_utf8_and_unknown_ids(library):
    model = bpe.load(VOCABULARY)
    ids = [i for p in ("日本", "🎉") for i in np.frombuffer(model.encode_packed([p])[0], "<u4").tolist()]
    for k in range(len(ids)):
        assert model.decode(ids[k:]) == library.decode(ids[k:], skip_special_tokens=False)
    with pytest.raises(ValueError):
        model.decode([model.size])


def test_round_trip_rows(docs_of):
    docs = docs_of([*ODD_TEXTS, ODD_TEXTS[5]])
    rows = bpe.round_trip_digests(docs, VOCABULARY).collect()
    assert len(rows) == len(ODD_TEXTS) + 1
    for r in rows:
        if r.doc_id is not None:
            text = dict(ODD_TEXTS)[r.doc_id] or ""
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert next(r for r in rows if r.doc_id == 0).n_tokens == 0
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    assert {(r.doc_id, r.text) for r in back} == {(d, t or "") for d, t in ODD_TEXTS}
    assert bpe.round_trip_digests(docs_of([]), VOCABULARY).count() == 0


# ---- personal data ----


def test_personal_base(texts):
    for text in [*texts, *random_texts("ab.@+-( )0123%_\n12.55 ", 3000, 60, 4), "1" * 5000, "a" * 9000, "1.2.3.4.5.6.7.8"]:
        assert pii.base_spans(text) == brute.base_personal(text)


def test_phone_is_found_again_without_its_sign(texts):
    field = pii.fit([m for m in map(pii.labelled, [*texts, *PHONES]) if m])
    text = "Call +1 (743) 555-3824 today.\nOr dial (743) 555-3824 again."
    (base, every), = pii.spans_of([text], field)
    assert [text[a:b] for _, a, b in base] == ["+1 (743) 555-3824"]
    assert set(base) <= set(every) and len(every) == 2
    clean = "No numbers here, only 12 eggs and 3.5 pounds of 2024 flour."
    assert pii.spans_of([clean], field) == [([], [])]


PHONES = [f"Please ring +1 ({200 + k}) 555-{4000 + 7 * k} before noon, or write a.b{k}@mail.example.com then." for k in range(40)]


def test_messages_on_a_tree_give_exact_marginals():
    rng = np.random.default_rng(1)
    kinds = pii.OUT + 1
    field = pii.Field(np.zeros((1, kinds)), rng.normal(size=(kinds, kinds)), rng.normal(size=(kinds, kinds)))
    score = rng.normal(size=(4, kinds))
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[1, 3]])
    got = field.marginals(score, chain, skip)
    want = np.zeros((4, kinds))
    for state in np.ndindex(*[kinds] * 4):
        total = sum(score[i, s] for i, s in enumerate(state))
        total += sum(field.chain[state[a], state[b]] for a, b in chain) + sum(field.skip[state[a], state[b]] for a, b in skip)
        for i, s in enumerate(state):
            want[i, s] += np.exp(total)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_personal_rows(spark, docs_of, testdata):
    rows = pii.find_personal_data(docs_of([*ODD_TEXTS, (20, PHONES[0]), (20, PHONES[0])])).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    assert all(r.spans == "" for r in rows if r.doc_id != 20)
    assert [(r.n_email, r.n_phone) for r in rows if r.doc_id == 20] == [(1, 1)] * 2
    assert pii.find_personal_data(docs_of([])).count() == 0
    docs = spark.read.parquet(f"{testdata}/sf0.001/documents.parquet")
    again = [sorted(map(tuple, pii.find_personal_data(d).collect())) for d in (docs, docs.repartition(3))]
    assert again[0] == again[1]


# ---- secrets ----


def test_secret_base(texts):
    odd = random_texts("tokensecrtapi_key=:'\" 0a1bfAKIA", 3000, 80, 5)
    odd += ["AKIA" + "Z" * 16, "ſecret=abcdefgh", "TOKEN: 'abcdef'", "api_key=12345", "f" * 24, "f" * 23, "a" * 9000]
    for text in [*texts, *odd]:
        assert secrets.base_spans(text) == brute.base_secrets(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    chain = secrets.Chain(rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    features = [[0], [1, 2], [3], [4, 5]]
    tags, scores = chain.best(features)

    def value(path):
        return chain.start[path[0]] + sum(scores[i, t] for i, t in enumerate(path)) + sum(
            chain.move[a, b] for a, b in zip(path, path[1:], strict=False)
        )

    assert value(tags) == max(value(p) for p in np.ndindex(3, 3, 3, 3))


def _path_value(chain, scores, path):
    moves = sum(chain.move[a, b] for a, b in zip(path, path[1:], strict=False))
    return chain.start[path[0]] + sum(scores[i, t] for i, t in enumerate(path)) + moves


def test_all_pieces_of_all_lines_are_tagged(texts):
    odd = random_texts("tokenscr_ky=:'\" 0a1bfAKIA.\n\u00b2\u0663\u00a0\x1c", 300, 80, 6)
    odd += ["", "\n", "a", "AKIA" + "Z" * 16, "PassWord: 'x'\n\n= key", "\u00b2 x", "passphrase" * 3]
    read = [*texts, *odd]
    pieces = secrets.pieces_of(read)
    rng = np.random.default_rng(7)
    emit = rng.normal(size=(len(secrets.FEATURES), 3)) + [0.5, 0.0, 0.0]
    chain = secrets.Chain(emit, rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = chain.scores_of(pieces.features)
    tags, is_open, at = chain.tag_lines(scores, pieces.first), chain.open(scores, pieces.first), 0
    for k, text in enumerate(read):
        begin = 0
        for line in text.split("\n"):
            places, features = secrets.window_pieces(text, begin, begin + len(line), secrets.file_features(text))
            part = slice(at, at + len(places))
            assert list(zip(pieces.start[part].tolist(), pieces.end[part].tolist(), strict=True)) == places
            assert [[k for k in range(len(secrets.FEATURES)) if f >> k & 1] for f in pieces.features[part].tolist()] == features and set(pieces.text[part].tolist()) <= {k}
            if places:
                best, own = chain.best(features)
                # Other tags are as good where features repeat.
                assert np.isclose(_path_value(chain, own, tags[part]), _path_value(chain, own, best), rtol=0, atol=1e-6)
            at += len(places)
            begin += len(line) + 1
    assert at == len(tags) and 0 < is_open.sum() < len(tags)


def test_secrets_far_from_digits_are_looked_at():
    emit = np.zeros((len(secrets.FEATURES), 3))
    emit[secrets.FEATURES.index("bias"), secrets.OUT] = 2.0
    emit[secrets.FEATURES.index("len20_31"), secrets.BEGIN] = 9.0
    text = "There is no number near the word qWbnRtZuiOpLkjHgFdSa in this line."
    at = text.index("qWbn")
    assert secrets.spans(text, secrets.Chain(emit, np.zeros((3, 3)), np.zeros(3))) == ([], [(at, 3, at + 20)])


def test_field_finds_what_patterns_miss(texts):
    made = [w for t in [*texts, *SECRETS] for w in secrets.labelled(t) or []]
    chain = secrets.fit(made)
    text = "The auth bearer 24BE64439E3E49CF46B2D7C90F3602A3D0B907FF was sent."
    base, every = secrets.spans(text, chain)
    assert base == [] and [text[a:b] for a, _, b in every] == ["24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"]
    for clean in ("Call +1 (743) 555-3824 or 4444555566667777 now.", "Version 3.11 has 240 pages and 12 figures."):
        assert secrets.spans(clean, chain) == ([], [])


SECRETS = [f'Then set token = "{hashlib.sha1(str(k).encode()).hexdigest()}" in the file and go on.' for k in range(60)]


def test_secret_rows(docs_of):
    rows = secrets.find_secrets(docs_of([*ODD_TEXTS, (20, SECRETS[0]), (20, SECRETS[0])])).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    assert [(r.n_assign, r.n_access, r.n_hex) for r in rows if r.doc_id == 20] == [(1, 0, 1)] * 2
    # 70,000 letters a are one run of hexadecimal digits.
    assert [(r.n_hex, r.spans) for r in rows if r.doc_id == 9] == [(1, "hex:0:70000")]
    assert all(r.spans == "" for r in rows if r.doc_id not in (9, 20))
    assert secrets.find_secrets(docs_of([])).count() == 0


def test_sample_has_the_few_positives_of_a_large_table(docs_of):
    rows = [(k, f"Chapter {k} has some {k % 97} pages.") for k in range(6000)]
    rows += [(10_000 + k, SECRETS[k] + " " + PHONES[k] + " " + "7 pages here. " * 10) for k in range(6)]
    df = docs_of(rows)
    for module in (pii, secrets):
        made = crf.labelled_sample(df, "doc_id", "text", module.labelled, module.sort_of, 40)
        assert len(made) == 40
        assert module.fit(made if module is pii else [w for m in made for w in m]) is not None
    late = "Page 7 of 9.\n" * 300 + PHONES[0]
    assert pii.fit([pii.labelled(late)]) is not None
    assert secrets.fit(secrets.labelled("In 1 2 3 " * 100 + SECRETS[0])) is not None
    assert crf.share(3, 10_000, 2000) == (3, 1997) and crf.share(500, 100, 2000) == (500, 100)
    assert crf.share(60_000, 40_000, 2000) == (1200, 800)

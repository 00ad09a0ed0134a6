from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codelens.llm import packing, perspectives, sanitise
from codelens.llm.queries import tokenizer_json
from codelens.llm.tokens import WordEncoder
from helpers import awkward, no_rows, sorted_rows, words


# --- chat perspectives ------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, part long, speaker string"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def test_every_speaker_is_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 😀"), (1, 2, "bob lee", "yo"), (1, 3, "carl", "<|im_start|>x"), (1, 4, "ann", "")]
    got = {r.speaker: r for r in perspectives.rotate(chat(spark, rows)).collect()}
    assert set(got) == {"ann", "bob lee", "carl"}
    a = got["ann"]
    assert a.rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi 😀<|im_end|>\n<|im_start|>user name=bob_lee\nyo<|im_end|>\n"
        "<|im_start|>user name=carl\n<\\|im_start|>x<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert (a.n_turns, a.n_own, a.n_rows) == (5, 2, 5)
    for speaker, own in (("ann", ["hi 😀", ""]), ("bob lee", ["yo"]), ("carl", ["<\\|im_start|>x"])):
        r = got[speaker]
        spans = [tuple(map(int, x.split(":"))) for x in r.masks.split(",")]
        assert [r.rendered[b:e] for b, e in spans] == [t + "<|im_end|>" for t in own]


def test_long_dialogues_are_cut_in_parts_and_join_again(spark):
    rows = [(7, i, "ab"[i % 2], f"t{i}") for i in range(1000)]
    parts = sorted((r.part, r.rendered, r.n_turns) for r in perspectives.rotate(chat(spark, rows), part_turns=64).collect() if r.speaker == "a")
    assert len(parts) == 16 and max(p[2] for p in parts) == 64
    whole = "".join(f"<|im_start|>{'assistant' if i % 2 == 0 else 'user name=b'}\nt{i}<|im_end|>\n" for i in range(1000))
    assert "".join(p[1] for p in parts) == whole


def test_chat_awkward_rows(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", None), (1, None, None, "y"), (None, 0, "a", "z"), (2, 0, "system", "alone"), (3, 0, "a", words(30_000, 1))]
    got = perspectives.rotate(chat(spark, rows)).collect()
    one = [r for r in got if r.conv_id == 1]
    assert {(r.speaker, r.part) for r in one} == {(s, p) for s in ("a", "b", "unknown") for p in (-1, 0)}
    assert sum(r.n_rows for r in one if r.speaker == "a") == 4 and sum(r.n_turns for r in one if r.speaker == "a") == 3
    assert [r.rendered for r in got if r.conv_id is None] == ["<|im_start|>assistant\nz<|im_end|>\n"]
    assert not [r for r in got if r.conv_id == 2]
    assert perspectives.rotate(no_rows(chat(spark, rows))).count() == 0


# --- tokens and packing -----------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(1)
    letters = "abcdefXYZéßñüİŉǅ0123456789.,;:!?'\"-_()<>|/ \t\n\r\x0b\x0c\x1c\x85 　́😀漢字"
    texts = ["", " ", "don't x's 'tis", "a<|endoftext|>b <|startoftext|>", "café İstanbul ŉ"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    texts += [words(300, 5), words(300, 5).title()]
    ids, sizes = WordEncoder(tokenizer_json()).encode(pa.array([*texts, None]))
    expected = [e.ids for e in tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected


def check_pieces(pieces, ids, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, whole in ids.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            part = whole[at : at + p.length]
            assert p.start == at and p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(part.tobytes()) and bytes(p.ids) == part.tobytes()
            at += p.length
        assert at == len(whole)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_round_trip(spark, tokenizer):
    docs = [(i, words(random.Random(i).randint(0, 900), i)) for i in range(60)] + [(60, None), (61, ""), (62, words(9000, 7))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    pieces = packing.pack(df, tokenizer_json(), end_id=1, shard_tokens=20_000).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    assert check_pieces(pieces, ids, 2048) == 0


def test_neighbours_are_the_lexically_closest():
    topics = [np.arange(100 * t, 100 * t + 40) for t in range(6)]
    rng = np.random.default_rng(0)
    docs = [rng.choice(topics[i % 6], 100) for i in range(48)]
    ids, sizes = np.concatenate(docs).astype(np.uint64), np.full(48, 100)
    pieces = packing.pack_shard(ids, sizes, np.ones(700), 100.0, 400)
    together = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        together[sequence].add(doc % 6)
    assert sum(len(t) == 1 for t in together.values()) >= 11
    index = packing.ShardIndex(ids, sizes, np.ones(700), 100.0)
    scores = index.scores(0)
    plain = [sum(2.2 * c / (c + 1.2) for t in set(docs[0]) if (c := (d == t).sum())) for d in docs]
    assert scores == pytest.approx(plain)


def test_near_copies_meet_in_a_shard(spark):
    docs = []
    for g in range(100):
        base = words(300, g).split()
        for copy in range(2):
            docs.append((copy * 100 + g, " ".join([*base[:-3], *words(3, 1000 + 2 * g + copy).split()])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    shards = defaultdict(set)
    for p in packing.pack(df, tokenizer_json(), end_id=1, shard_tokens=20_000).select("doc_id", "sequence_id").collect():
        shards[p.doc_id].add(p.sequence_id >> 32)
    assert len(set.union(*shards.values())) >= 5 and all(len(x) == 1 for x in shards.values())
    assert sum(shards[g] == shards[100 + g] for g in range(100)) >= 85


def test_packing_awkward_rows(spark):
    docs = awkward(spark)
    pieces = packing.pack(docs, tokenizer_json()).collect()
    total = {r.doc_id: 0 for r in docs.collect()}
    for p in pieces:
        total[p.doc_id] += p.length
    assert total[4] == total[5] == 1 and total[1] == total[2] and total[9] % 2 == 0 and total[7] == total[8] > 30_000
    assert packing.pack(no_rows(docs), tokenizer_json()).count() == 0


# --- personal data ----------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            valid = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if valid:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{b}:{e}" for b, _, k, e in sorted(out))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(4)
    cases = [
        "a@b.c.d@e.f x@y a@b. a@b..c a@b.c_d@e.f ..x@y.z", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.02.3.255 1.2.3.4.5", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 5 4111111111111112",
        "+1 (212) 555-0100 +1 +12 + 49 30 1234567 +49301234567.", "😀 ann@example.com 😀 10.0.0.1", "1" * 5000, "1-" * 4000, "a" * 20_000 + "@", "+" * 50, "4111111111111111@x.y +14111111111111", "",
    ]
    cases += ["".join(rng.choice("ab1234.@+-() 5.5") for _ in range(rng.randint(5, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in sanitise.report(df).collect():
        expected = plain_spans(cases[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), cases[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [expected.count(k + ":") for k in PLAIN]
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == expected


def test_terms_that_reveal_an_entity_are_changed(spark):
    rows = [f"line {words(3, i)} falconer wrote to ann@example.com about things" for i in range(4)]
    rows += [f"other {words(4, 50 + i)} about wrote things to" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in sanitise.report(df).collect()}
    begin = rows[0].index("falconer")
    assert f"term:{begin}:{begin + 8}" in spans[0]
    assert all("term" not in spans[i] for i in range(4, 204)) and "email" in spans[3]
    changed = [rows[0][int(b) : int(e)] for k, b, e in (x.split(":") for x in spans[0].split(",")) if k == "term"]
    assert "falconer" in changed and "about" not in changed and "wrote" not in changed
    text = {r.doc_id: r.text for r in sanitise.sanitised(df).collect()}
    assert "falconer" not in text[0] and "[EMAIL]" in text[0] and "ann@" not in text[0] and text[10] == rows[10]


def test_strength_equals_the_formula(spark):
    lines = [(i, 0, f"t{i % 2} common {i}x", "email:e") for i in range(4)]
    entity_lines = spark.createDataFrame(lines, "uid long, line int, text string, entity string")
    every = spark.createDataFrame([(t,) for _, _, t, _ in lines] + [("common t1",)] * 6, "text string")
    got = {r.term: r.strength for r in sanitise.disclosing(entity_lines, every, 10, sanitise.Settings(generalise=-9, shortest=2)).collect()}
    worth = -np.log(4 / 10)
    assert got == pytest.approx({"t0": 1.0, "t1": 1 + np.log(2 / 8) / worth, "common": 1 + np.log(4 / 10) / worth})


def test_sanitise_awkward_rows(spark):
    docs = awkward(spark)
    report = sanitise.report(docs)
    assert report.count() == docs.count()
    twelve = report.where("doc_id = 12").first()
    assert (twelve.n_email, twelve.n_ip, twelve.n_card, twelve.n_phone) == (1, 1, 0, 1)
    assert sanitise.sanitised(docs).where("doc_id = 12").first().text == "mail [EMAIL] and [IP] 😀 [PHONE]"
    assert sorted_rows(report) == sorted_rows(sanitise.report(docs.repartition(1)))
    assert sanitise.report(no_rows(docs)).count() == 0

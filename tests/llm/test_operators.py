"""Operators against plain versions of themselves on small hand-made tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import sys
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
public_tokenizers = pytest.importorskip("public_tokenizers")

from tremorgrade.llm import (  # noqa: E402
    chat,
    contamination,
    fingerprints,
    jaccard_join,
    licenses,
    memory,
    quality,
    suffix_dedup,
    token_files,
    unigram,
    urls,
)
from tremorgrade.llm.components import components  # noqa: E402
from tremorgrade.llm.store import new_path  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module", autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="module")
def documents(spark):
    """Copies, near copies, shared passages, repeats, nulls, empty, tiny and one long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = prose(60), prose(120)
    texts = [None, "", " \n\t ", "one", "ONE", "two words", "a b c d e", "A b  c d e", "a b c d e f"]
    texts += [prose(rng.randint(1, 30)) for _ in range(40)]
    texts += [base, base, base.upper(), base + " end", base.replace(vocabulary[3], "x")]
    texts += [f"{prose(50)} {passage} {prose(40)}" for _ in range(6)] + [passage, passage[:-1] + "!"]
    texts += ["ab" * 300, "z" * 450, prose(3) * 30, prose(9000), "日本語 😀 text\x00 ▁ x  y", "é" * 150]
    small = "q w e r t y u i o p".split()
    texts += [" ".join(small[: k + 5]) for k in range(6)] + [" ".join(small[k:]) for k in range(4)]
    rows = [(10 * i - 30, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def texts_of(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_suffix_dedup_removes_what_repeats(documents):
    texts = {i: t.encode() for i, t in texts_of(documents).items()}
    seen = {}
    for text in texts.values():
        for k in range(len(text) - 199):
            seen[text[k : k + 200]] = seen.get(text[k : k + 200], 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(documents).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        gone = [False] * len(text)
        for k in range(len(text) - 199):
            if seen[text[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        assert (got[i].n_bytes, bytes(got[i].kept)) == (len(text), kept), i
        runs = [k for k, g in itertools.groupby(gone) if k]
        assert len(got[i].spans) == len(runs)


def test_suffix_dedup_folds_texts_that_repeat_a_few_words(spark):
    """A pair of words said thousands of times is one member a text and bucket, not one a time."""
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    unit = prose(40)
    texts = [f"{prose(50)} {'red fox ' * 1500}{prose(50)}" for _ in range(5)]
    texts += [unit[:size] * times for size, times in ((150, 60), (199, 3), (200, 2), (230, 40), (260, 2))]
    texts += [unit[:137] + "-" + unit[:137], "ab" * 70_000 + prose(40), prose(60) + " " + "z" * 199]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    seen = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.cut_repeats(frame).collect()}
    for i, text in rows:
        left, until = [], 0
        for k, c in enumerate(text):
            if k + 200 <= len(text) and seen[text[k : k + 200]] > 1:
                until = k + 200
            if k >= until:
                left.append(c)
        assert got[i] == "".join(left), i

    pairs = frame.where("doc_id < 5")
    members = suffix_dedup._anchors(pairs)
    assert members.count() < 200
    stands_for = members.selectExpr("max(shiftright(extent, 36))").first()[0]
    assert stands_for > 1400


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


@pytest.mark.parametrize("light", [None, 0, 8])
def test_jaccard_join_finds_every_component(documents, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda sizes: light)
    sets = {i: shingle_set(t) for i, t in texts_of(documents).items()}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = jaccard_join.jaccard_join(documents).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(
        (i, len(s), find(i)) for i, s in sets.items()
    )


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    base, clean, twice, passage, leak = prose(80), prose(90), prose(70), prose(60), prose(20)
    shared = [prose(30) + passage + prose(30) for _ in range(2)]
    rows = [
        (1, base), (5, base + " end"), (5, clean), (7, twice), (7, twice), (8, ""), (8, ""),
        (9, shared[0]), (9, prose(12)), (10, shared[1]), (11, leak), (11, prose(40)), (None, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = [(5, base + " end"), (7, twice)]
    left = list(rows)
    for row in gone:
        left.remove(row)
    by = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, jaccard_join.keep_first(frame).collect()), key=by) == sorted(left, key=by)
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_join(frame).collect())
    assert found == sorted((i or 0, 1 if t == base + " end" else i or 0) for i, t in rows)

    cut = sorted((r.doc_id or 0, r.n_bytes, bytes(r.kept).decode()) for r in suffix_dedup.cut_repeats(frame).collect())
    whole = {t: t for _, t in rows if t and t not in (base, base + " end", twice, *shared)}
    for i, size, kept in cut:
        if size and size in map(len, whole.values()):
            assert kept in whole
    assert len(cut) == len(rows)
    assert [k for i, _, k in cut if i == 7] == ["", ""]
    assert sorted(k for i, _, k in cut if i == 5) == sorted([clean, " end"])

    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    free = [r for r in rows if r[1] != leak]
    assert sorted(map(tuple, contamination.decontaminate(frame, items).collect()), key=by) == sorted(free, key=by)


def test_boundary_weighs_subsets_against_places():
    assert jaccard_join.boundary({}) == 0
    assert jaccard_join.boundary({4: 1000}) >= 4  # a set of four has one subset
    assert jaccard_join.boundary({30: 1000}) < 30  # one of thirty has hundreds of thousands


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 40)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {
        **{i: 0 for i in range(21)}, 40: 40, 50: 40
    }


def test_masks_agree_on_thirteen_words_with_two_substituted():
    shifts = range(contamination.WINDOW - contamination.SPAN + 1)
    for gone in itertools.combinations(range(contamination.WINDOW), 2):
        assert any(all(s + k not in gone for k in mask) for mask in contamination.MASKS for s in shifts)


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_decontamination_tolerates_substitutions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(contamination, "BROADCAST_WORDS", broadcast)
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame(
        [(1, " ".join(words[:20])), (2, " ".join(words[30:34])), (3, None), (4, "")], "item_id long, text string"
    )
    changed = words[:20]
    changed[4], changed[9] = "x", "y"
    half = [w if i % 2 else "no" for i, w in enumerate(words[:20])]
    rows = [
        (1, "a b " + " ".join(words[:20]) + " c"),
        (2, "A, B; " + ", ".join(changed).upper()),
        (3, " ".join(half)),
        (4, " ".join(words[30:34])),
        (5, None),
        (6, ""),
        (7, "c " * 500),
    ]
    found = contamination.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (4, 2)}


def test_short_masks_miss_all_allowed_substitutions():
    for n in range(1, contamination.WINDOW):
        assert all(contamination.short_masks(n))
        for gone in itertools.combinations(range(n), contamination.allowed(n)):
            assert any(not set(mask) & set(gone) for mask in contamination.short_masks(n))


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_short_items_are_found_inside_long_documents(spark, monkeypatch, broadcast):
    monkeypatch.setattr(contamination, "BROADCAST_WORDS", broadcast)
    lengths = [1, 2, 4, 5, 8, 9, 10, 12, 13]
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in lengths}
    rows, expected = [], set()
    for n, words in items.items():
        for changed in range(4):
            for gone in itertools.combinations(range(n), min(changed, n)):
                if changed > 1 and gone[0] % 3:
                    continue  # some of many
                own = [f"no{k}" if k in gone else w for k, w in enumerate(words)]
                for before, after in ((30, 1500 if n == 9 and changed < 2 else 30), (0, 0), (0, 20), (20, 0)):
                    rows.append((len(rows), " ".join(["a"] * before + own + ["b"] * after)))
                    if (n - len(gone)) / n >= 0.8:
                        expected.add((rows[-1][0], n, before, n - len(gone)))
    found = contamination.find_overlaps(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {e[:2] for e in expected}
    exact = {(r.doc_id, r.item_id, r.first_word, r.matched) for r in found if r.item_id < 13}
    assert exact == {e for e in expected if e[1] < 13}


def test_fingerprints_and_neighbours(documents):
    texts = texts_of(documents)
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(documents.repartition(5)).collect()}
    assert got.keys() == texts.keys()
    prints = {}
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        changed = fingerprints.edited(texts[i], texts[following])
        assert got[i].n_chars == len(texts[i])
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_next == 1) >= (texts[i] == texts[following])
        prints.setdefault(texts[i], set()).add(got[i].fingerprint)
        prints.setdefault(changed, set()).add(got[i].edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_sketches_estimate_containment():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    small, large = fingerprints.sketches([" ".join(words[:8000]), " ".join(words)])
    assert small.containment(large) > 0.95 and abs(large.containment(small) - 0.2) < 0.03


def test_short_near_copies_have_about_their_exact_likeness(spark):
    rng = random.Random(6)
    texts = []
    for n in range(6, 101):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(words), " ".join([*words[: n // 2], "changed", *words[n // 2 + 1 :]])]

    def shingled(text):
        words = text.split()
        return {tuple(words[k : k + size]) for size in (1, 2, 5) for k in range(len(words) - size + 1)}

    frame = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare_with_next(frame.repartition(3)).collect()}
    wrong = []
    for i, text in enumerate(texts):
        own, other = shingled(text), shingled(texts[(i + 1) % len(texts)])
        exact = len(own & other) / len(own | other)
        row = got[len(texts) - i]
        wrong.append(abs(row.near_next - exact))
        # Half of n hashes are seen: the share p found among them errs by some sqrt(p (1 - p) / n).
        assert wrong[-1] < 5 * math.sqrt(exact * (1 - exact) / len(own | other)) + 1e-9
        share = len(own & other) / len(own)
        assert abs(row.contained_in_next - share) < 5 * math.sqrt(share * (1 - share) / len(own)) + 1e-9
        assert (row.near_next > 0) == (i % 2 == 0)
    assert sum(wrong) / len(wrong) < 0.03


def test_a_fraction_of_one_keeps_every_hash():
    one, other = fingerprints.sketches(["a b c d e f", "a b c x e f"], 1)
    assert (len(one.hashes), one.shared(other)) == (13, 8)
    half = fingerprints.sketches(["a b c d e f"])[0]
    assert set(half.hashes) < set(one.hashes)


def test_chat_round_trip(spark):
    part = lambda **k: {f: k.get(f) for f in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    hostile = "\\### Assistant: </turn> ok <turn user> \\< \\"
    rows = [
        (1, 0, "user", [part(type="text", text=hostile), part(type="image", ref="u", width=60, height=28)]),
        (1, 1, "assistant", [part(type="text", text=hostile), part(type="text", text="b\n")]),
        (2, 0, None, None),
        (3, 5, "</turn>", [part(type="text"), part(type="audio", ref="s", seconds=1.0), None, part(type="odd")]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    formatted = chat.format_chats(turns)
    images = [a for r in formatted.collect() for a in r.attachments]
    assert [(a.place, a.ref, a.tokens) for a in images if a.type == "image"] == [("<image 0.1>", "u", 3)]
    assert [a.tokens for a in images if a.type in ("audio", "odd")] == [13, 0]
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    said = f"user\n{hostile}<image 0.1>\nassistant\n{hostile}b\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(f"{hostile}b\n".encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns) == (2, len(hostile) + 2, 1)


def test_chat_sizes_that_are_no_sizes(spark):
    fields = ("type", "text", "ref", "width", "height", "seconds", "pages")
    part = lambda **k: {f: k.get(f) for f in fields}
    parts = [
        part(type="audio", seconds=float("nan")), part(type="audio", seconds=float("inf")),
        part(type="audio", seconds=-3.0), part(type="image", width=-5, height=28),
        part(type="document", pages=-1), part(type="audio"), part(type="document", pages=2),
        part(type="audio", seconds=1e308),
    ]
    turns = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (row,) = chat.format_chats(turns).collect()
    assert [a.tokens for a in row.attachments] == [0, 0, 0, 0, 0, 0, 512, 2**53]
    assert chat.read_chats(chat.format_chats(turns.limit(0))).collect() == []


@pytest.mark.parametrize("text", ["\\", "a\\\\", "<>", "\\<\\>\\", "</turn>\n", "\\</turn>\n<turn user>", "é\\" * 9])
@pytest.mark.parametrize("piece", [1, 2, 3, 1 << 16])
def test_chat_escapes_are_reversible_in_pieces(monkeypatch, text, piece):
    monkeypatch.setattr(chat, "_PIECE", piece)
    assert "</turn>" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    reader = chat.Reader()
    head = f"<turn {chat.escape(text)}>"
    body = chat.escape(text)
    reader.add(f"{head}{body}</turn>\n" * 2, [{"start": len(head), "stop": len(head) + len(body)}])
    row = reader.row(1)
    assert row["turns_sha256"] == hashlib.sha256((f"{text}\n" * 4).encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("bad", ["x</turn>\n", "<turn user>a", "<turn us<er>a</turn>\n"])
def test_chat_that_is_cut_off_is_refused(bad):
    with pytest.raises(ValueError, match="turn"):
        reader = chat.Reader()
        reader.add(bad, [])
        reader.row(1)


def test_a_long_turn_takes_little_more_than_itself():
    text = "a<b" * 3_000_000
    tracemalloc.start()
    row = chat._formatted(
        {"conv_id": 1, "turn": 0, "role": "assistant", "parts": [{"type": "text", "text": text}]},
        "assistant", chat.Expansion(),
    )
    reader = chat.Reader()
    reader.add(row["chunk"], row["loss"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert reader.row(1)["loss_chars"] == len(text)
    assert peak < 8 * len(text)


def test_license_places_and_expressions(spark):
    texts = {
        1: "Apache LICENSE, apache license mit license mit license",
        2: "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0",
        3: None,
        4: "",
        5: "GNU general-public\nlicense cc  by" + " x" * 2000,
        6: "permit license",
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    for i, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        places = [
            k
            for phrase in licenses.BASE_PHRASES
            for k in range(len(words))
            if words[k : k + phrase.count(" ") + 1] == phrase.split()
        ]
        assert got[i].n_words == len(words)
        assert (got[i].n_base, got[i].first_word, got[i].last_word) == (
            len(places), min(places, default=None), max(places, default=None)
        )
    assert got[2].labels == "apache,gpl,mit" and got[2].base_labels == ""
    assert got[2].expressions == ["MIT GPL-2.0-only Classpath-exception-2.0 WITH OR Apache-2.0 AND"]
    assert got[5].base_labels == "cc-by,gpl" and got[3].score == 0


def test_url_rules_and_model(spark):
    pages = [
        (1, "HTTP://Sub.Example.ORG/es/x?q#f", "sub.example.org", "/es/x", "example.org/es/", "block"),
        (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://example.org/fr", "example.org", "/fr", "org/", "allow"),
        (4, "http://badexample.com/de/", "badexample.com", "/de/", "com/de/", "block"),
        (5, "http://x.com", "x.com", "", None, None),
        (6, None, "", "", None, None),
        (7, "no scheme", "", "", None, None),
        (8, "a://b?c://d/e", "b", "", None, None),
    ]
    frame = spark.createDataFrame([p[:2] for p in pages], "page_id long, url string")
    weights, bias = urls.train(urls.ruled_urls(frame, urls.RULES))
    got = {r.page_id: r for r in urls.filter_urls(frame, urls.RULES, weights, bias).collect()}
    for page_id, _, host, path, rule, verdict in pages:
        row = got[page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")


def test_url_model_learns_held_out_urls(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(i, f"http://{name()}.com/{'casino' if i % 2 else 'garden'}/{name()}", i % 2) for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, block int")
    weights, bias = urls.train(frame.where("page_id < 200"))
    got = urls.filter_urls(frame.where("page_id >= 200"), [], weights, bias).collect()
    right = sum((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    assert right >= 95


def test_quality_on_held_out_documents(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        text = rng.choices(words, k=40)
        text = text if good else [w + "###$$$" for w in text]
        rows.append((i, " ".join(text + ["vile"] * toxic), "en", f"src{i % 5}", None if i % 7 == 0 else 200))
        labels.append((i, int(good), int(toxic)))
    rows.append((1000, None, None, None, None))
    documents = spark.createDataFrame(rows, DOCUMENTS)
    taught = spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int")
    models = quality.train(documents, taught)
    got = {r.doc_id: r for r in quality.score(documents, models).collect()}
    right = [got[i].keep == bool(good and not toxic) for i, good, toxic in labels[250:]]
    assert sum(right) >= 0.97 * len(right) and 1000 in got
    assert {r.doc_id for r in quality.keep_good(documents, models).collect()} == {i for i in got if got[i].keep}
    untaught = quality.train(documents, taught.where("false"))
    assert all(r.keep for r in quality.score(documents, untaught).collect())


def test_quality_learns_from_every_unlabelled_document(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    text = lambda extra: " ".join(rng.choices(words, k=12) + extra)
    foul = {i for i in range(5000) if i % 25 == 0 or (i < 300 and i % 3 == 0)}
    rows = [
        (i, text(["vile" if i < 300 else "grue"] if i in foul else []), "en", "foul" if i in foul else "fair", 60)
        for i in range(5000)
    ]
    labels = [(i, None if i % 2 else 1, int(i in foul)) for i in range(300)]
    taught, sums = [], quality._sums

    def spy(*given):
        found = sums(*given)
        taught.append([n for n, _, _ in found["toxic"]])
        return found

    monkeypatch.setattr(quality, "_sums", spy)
    documents = spark.createDataFrame([*rows, (None, text([]), "en", "fair", 60)], DOCUMENTS)
    models = quality.train(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert taught[-1][0] == 4701  # the text view: by metadata, which is sure of all
    alone = [(1, text(["grue"]), "xx", "new", 60), (2, text([]), "xx", "new", 60)]
    got = {r.doc_id: r.toxic for r in quality.score(spark.createDataFrame(alone, DOCUMENTS), models).collect()}
    assert got[1] > 0.5 > got[2]


def test_unigram_splits_as_well_as_the_library(documents):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as model_file

    file = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = unigram.load(file)
    model = model_file.ModelProto()
    with open(file, "rb") as held:
        model.ParseFromString(held.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if vocabulary.normal[i]:
            piece.score = float(vocabulary.scores[i])
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    encoded = unigram.encode(documents.select("doc_id", "text"), file)
    decoded = {r.doc_id: r.decoded for r in unigram.decode(encoded, file).collect()}
    worth = lambda ids: sum(vocabulary.scores[i] for i in ids if vocabulary.normal[i])
    for row in encoded.collect():
        text = row.text or ""
        theirs = library.encode(text)
        assert worth(row.token_ids) == pytest.approx(worth(theirs), rel=1e-5), text[:40]
        assert sum(not vocabulary.normal[i] for i in row.token_ids) == sum(not vocabulary.normal[i] for i in theirs)
        assert decoded[row.doc_id] == text.replace(unigram.MARKER, " ")
    one_pass = {r.doc_id: r for r in unigram.round_trips(documents, file, "token_ids").collect()}
    for row in encoded.collect():
        found = one_pass[row.doc_id]
        assert found.token_ids == row.token_ids and found.n_tokens == len(row.token_ids)
        assert found.ids_crc32 == zlib.crc32(np.array(row.token_ids, "<u4").tobytes())
        assert found.round_trip == (decoded[row.doc_id] == (row.text or ""))


def test_long_stretches_split_as_short_ones_do(monkeypatch):
    model = unigram.Unigram(unigram.load(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(3)
    stretches = ["".join(rng.choices(letters, k=rng.randint(1, 300))) for letters in ("ab", "etaoin", "日本é😀x", "\x00A9/+") for _ in range(20)]
    together = model.split_all(stretches)
    monkeypatch.setattr(unigram, "_LONG", 40)
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(unigram, "_LONG_BLOCK", block)
        alone = model.split_all(stretches)
        assert all(np.array_equal(a, b) for a, b in zip(together, alone, strict=True))


def test_text_without_blanks_takes_time_in_proportion():
    model = unigram.Unigram(unigram.load(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(4)
    text = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=400_000))
    began = time.process_time()
    ids, sizes = model.split_all([text])
    assert time.process_time() - began < 8  # 25 s and more place by place in arrays
    assert sizes.tolist() == [len(ids)]
    assert b"".join(model.vocabulary.pieces[i] for i in ids).decode() == text


def test_token_files_hold_the_library_s_ids(spark, documents):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    odd = spark.createDataFrame(
        [(10**6 + i, t, None, None, None) for i, t in enumerate(["<|endoftext|> x<|STARTOFTEXT|>.", "it's \"q\"., é!! ß İx ﬁ"])],
        DOCUMENTS,
    )
    every = documents.union(odd)
    path = new_path(spark, "tokens")
    token_files.write_tokens(every, path, file)
    got = {r.doc_id: r for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
    start = 0
    for i, text in sorted(texts_of(every).items()):
        ids = [*library.encode(text, add_special_tokens=False).ids, token_files.END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc), text[:40]
        start += len(ids)


def test_encoder_looks_each_core_up_once():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(file), token_files.WordEncoder(file)
    texts = ["Word word, WORD. \"word\" word", "<|ENDOFTEXT|>, <|endoftext|>.", "", "é É, é!! İ. \u0958., \ufb2a! ß ﬁ 1 x2; --", "... a.b. a.b"]
    numbers, asked = encoder.memory.numbers, []
    encoder.memory.numbers = lambda *lists: asked.extend(map(list, lists)) or numbers(*lists)
    for part in (texts, texts[:1], [""]):
        ids, counts = encoder.encode(pa.array(part, pa.string()))
        cores = asked[0]
        asked.clear()
        assert len(cores) == len(set(cores))
        theirs = [[*library.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in part]
        assert ids.tolist() == sum(theirs, []) and counts.tolist() == list(map(len, theirs))


def test_a_full_memory_keeps_words_that_come_up_again():
    """So it can be small: all words forgotten at once would be encoded again, common ones too."""
    asked = collections.Counter()

    def spell(words):
        asked.update(words)
        return np.array([ord(c) for w in words for c in w]), np.array([len(w) for w in words], np.int64)

    words = memory.Memory(spell, kept=100)
    common = [f"common{i}" for i in range(20)]
    for k in range(60):
        rare = [f"rare{k}-{i}" for i in range(10 + k % 3)]
        first, second = words.numbers(common + rare, ["", common[k % 20]])
        assert "".join(map(chr, words.ids(first))) == "".join(common + rare)
        assert "".join(map(chr, words.ids(second))) == common[k % 20]
        assert words.lengths[first].tolist() == [len(w) for w in common + rare]
        assert len(words.known) <= 100 + 13
    assert {asked[w] for w in common} == {1}

    few = memory.Memory(spell, kept=4)
    for k in range(8):
        numbers = few.numbers([f"w{k % 2}-{i}" for i in range(6)])[0]
        assert "".join(map(chr, few.ids(numbers))) == "".join(f"w{k % 2}-{i}" for i in range(6))


def test_empty_tables(spark, documents):
    none = documents.where("false")
    file = public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    path = new_path(spark, "tokens")
    token_files.write_tokens(none, path, file)
    frames = [
        suffix_dedup.cut_repeats(none),
        jaccard_join.jaccard_join(none),
        contamination.find_overlaps(none, items),
        contamination.find_overlaps(documents, items),
        fingerprints.compare_with_next(none),
        licenses.scan_licenses(none),
        quality.score(none, quality.train(none, labels)),
        token_files.checksums(token_files.read_tokens(spark, path)),
    ]
    assert all(frame.count() == 0 for frame in frames)

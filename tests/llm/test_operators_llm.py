"""Training-data operators on small tables: edge cases, brute force, and the tokenizer library."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece

from rollcall.llm import fingerprints, html_extraction, license_scan, parity_join, pii, quality_rules, sentencepiece_codec, sharding, source_mix, token_counts
from rollcall.llm.pieces import vocabulary
from rollcall.workdir import settle

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    names = ["the", "of", "and", "alder", "brook", "cedar", "delta", "ember", "fjord", "grove", "haven", "inlet", "jetty"]
    return " ".join(rng.choice(names) + (str(rng.randint(0, 40)) if rng.random() < 0.7 else "") for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 9999)}"
    return " ".join(words)


def corpus() -> list[tuple]:
    """Nulls, empty, blank and very long texts, ties, copies, near copies, repeated rows and ids."""
    base = prose(1, 120)
    texts = [None, "", " \n\t ", "one", "One", "a b c", base, base, base.upper(), prose(2, 20_000), "x" * 50_000, "é漢😀   ▁▁ y"]
    texts += [edited(prose(3, 200), i, 1 + i % 4) for i in range(12)] + [edited(prose(4, 60), i, i % 3) for i in range(8)]
    texts += ["mail Bob.x@mail.example.org or +1 (017) 555-7713, 10.0.0.256 and 10.0.0.25, 4111 1111 1111 1111 end"] + [prose(50 + i, 30 + i) for i in range(10)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, base, None, "s1", 3), (12, prose(99, 50), "en", "s2", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    # names that operators use within
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(corpus(), DDL)
    return settle(frame.withColumns({c: F.lit("clash") for c in ("words", "key", "uid", "shard", "size", "hub", "rn", "bucket", "_row", "terms", "k", "a", "node")}), "corpus")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    for run in (
        quality_rules.judge, quality_rules.keep_good, lambda d: token_counts.count_tokens(d, MODEL), license_scan.license_report,
        lambda d: sentencepiece_codec.digest_documents(d, MODEL), lambda d: sentencepiece_codec.encode_documents(d, MODEL),
        source_mix.report, source_mix.mixed_documents, sharding.assign_shards, fingerprints.report, pii.report, pii.redact,
        parity_join.near_duplicates, parity_join.first_of_groups,
    ):
        assert run(none).count() == 0
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokens_and_encoding_equal_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = [(i, library.encode(t or "")) for i, t, *_ in corpus()]
    texts = [t or "" for _, t, *_ in corpus()]
    counts = token_counts.count_tokens(docs, MODEL, limit=100)
    assert rows_of(counts) == sorted(((i, len(t.encode()), len(ids), len(ids) > 100) for (i, ids), t in zip(expected, texts, strict=True)), key=str)
    digests = sentencepiece_codec.digest_documents(docs, MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows_of(digests) == sorted(((i, len(ids) + 1, sha(" ".join(map(str, ids + [2]))), sha(library.decode(ids + [2]))) for i, ids in expected), key=str)
    encoded = sentencepiece_codec.encode_documents(docs, MODEL).select("doc_id", "ids", "decoded")
    assert rows_of(encoded) == sorted(((i, ids + [2], library.decode(ids + [2])) for i, ids in expected), key=str)


def test_codec_on_random_text():
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_codec.Encoder(vocabulary(MODEL))
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab the in er▁ \n\t\x00éß漢😀  1<>/") for _ in range(rng.randint(0, 40)))
        ids = sentencepiece_codec.encode(text, encoder)
        assert ids == [*library.encode(text), 2] and sentencepiece_codec.decode(ids, encoder) == library.decode(ids)


def test_quality_counts_by_brute_force(docs):
    expected = []
    for i, t, *_ in corpus():
        words = WORD.findall(t or "")
        windows = collections.Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        covered = {j + d for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        expected.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed))
    got = quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got) == sorted(expected, key=str)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.judge(docs).filter("kept").count() > 5


def test_near_duplicates_by_brute_force(docs):
    for size, percent in ((4, 85), (5, 80)):
        sets = collections.defaultdict(list)
        for i, t, *_ in corpus():
            words = WORD.findall((t or "").translate(LOWER))
            sets[i].append({tuple(words[j : j + size]) for j in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
        ids = [i for i in sets if i is not None]
        root = {i: i for i in ids}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in ids:
            for b in ids:
                if a < b and any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        seen = collections.Counter()
        expected = []
        for i, *_ in corpus():
            expected.append((i, len(sets[i][min(seen[i], len(sets[i]) - 1)]), None if i is None else find(i)))
            seen[i] += 1
        assert rows_of(parity_join.near_duplicates(docs, size, percent)) == sorted(expected, key=str)
    kept = parity_join.first_of_groups(docs, 5, 80)
    assert kept.columns == docs.columns
    # every row is decided on by its own text, whatever its id
    rows = [(i, t, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())) for i, t, *_ in corpus() for w in [WORD.findall((t or "").translate(LOWER))]]
    group = list(range(len(rows)))
    for _ in rows:  # labels spread until nothing changes
        for a in range(len(rows)):
            for b in range(len(rows)):
                x, y = rows[a][2], rows[b][2]
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = min(group[a], group[b])
    staying = collections.defaultdict(list)
    for (i, t, _), g in zip(rows, group, strict=True):
        staying[g].append((i is None, i or 0, t))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(None if none else i) for none, i, _ in map(min, staying.values()))
    assert not {r.text for r in kept.filter("doc_id = 12").collect()} - {t for i, t, *_ in corpus() if i == 12}


def test_near_duplicates_of_a_pivot_of_all_its_keys(spark):
    # of ids a < b < c, b is like c and has keys with it alone; c also has keys with a, by a common passage or as a's near copy
    def held(text):
        (s,) = parity_join.shingle_sets([text], 4)
        return s, {int(k) for number in parity_join.bands(len(s), 85) for k in parity_join.block_keys(s, number, 85)[0]}

    rows, expected, linked = [], [], []
    for seed in range(200):
        n, front, place = ((16, 1, 15), (60, 36, random.Random(seed).randrange(40, 60)))[seed % 2]
        c = [f"w{seed}x{i}" for i in range(n)]
        texts = [" ".join([f"a{seed}x{i}" for i in range(front)] + c[front:]), " ".join(c[:place] + ["other"] + c[place + 1 :]), " ".join(c)]
        (sa, ka), (sb, kb), (sc, kc) = map(held, texts)
        if ka & kc and kb & kc and not ka & kb and parity_join.alike(sb, sc, 85) and not parity_join.alike(sa, sb, 85):
            linked.append(parity_join.alike(sa, sc, 85))
            at = 3 * seed
            rows += [(at + i, t) for i, t in enumerate(texts)]
            expected += [(at, at), *[(at + i, at if linked[-1] else at + 1) for i in (1, 2)]]
    assert True in linked and False in linked
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).select("doc_id", "component_id")
    assert rows_of(got) == sorted(expected, key=str)


def test_bands_keep_every_linked_pair():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(3))
    for percent in (80, 85):
        for _ in range(300):
            n = int(rng.integers(1, 150))
            first = rng.integers(1, 1 << 62, n).astype(np.uint64)
            second = np.concatenate([first[int(rng.integers(0, max(1, n // 6))) :], rng.integers(1, 1 << 62, int(rng.integers(0, max(1, n // 8)))).astype(np.uint64)])
            if parity_join.alike(np.unique(first), np.unique(second), percent):
                keys = [{int(k) for b in parity_join.bands(len(s), percent) for k in parity_join.block_keys(s, b, percent)[0]} for s in (first, second)]
                assert keys[0] & keys[1]


def test_fingerprints(docs):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    got = fingerprints.report(docs).collect()
    assert len(got) == len(rows)
    expected = []
    for j, (i, t, *_) in enumerate(rows):
        t, following = t or "", rows[(j + 1) % len(rows)][1] or ""
        half = len(t) // 2
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(expected, key=str)
    texts = collections.defaultdict(set)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        texts[r.doc_id].add(r.fingerprint)
    assert texts[6] == texts[7] and texts[1] == {""} and len(texts[6].pop()) == 8 * fingerprints.SAMPLES


def test_sampling_estimates_weighted_jaccard(spark):
    pairs = [(2 * i, prose(i, 80)) for i in range(40)]
    pairs += [(i + 1, edited(t, i, 20)) for i, t in pairs]
    prints = {r.doc_id: r.signature for r in fingerprints.fingerprint(spark.createDataFrame(pairs, "doc_id long, text string"), ["doc_id"], 64).collect()}
    texts, error = dict(pairs), []
    for i in range(0, 80, 2):
        a, b = collections.Counter(texts[i].split()), collections.Counter(texts[i + 1].split())
        same = sum(x == y for x, y in zip(prints[i], prints[i + 1], strict=True)) / 64
        error.append(same - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(error) / len(error)) < 0.06 and max(map(abs, error)) < 0.3


def test_sampling_error_of_the_registered_query(spark):
    pairs = [(2 * i, prose(i, 80)) for i in range(100)]
    pairs += [(i + 1, edited(t, i, 5 + 5 * (i % 5))) for i, t in pairs]
    prints = {r.doc_id: r.signature for r in fingerprints.fingerprint(spark.createDataFrame(pairs, "doc_id long, text string"), ["doc_id"]).collect()}
    texts, error = dict(pairs), []
    for i in range(0, 200, 2):
        a, b = collections.Counter(texts[i].split()), collections.Counter(texts[i + 1].split())
        assert len(prints[i]) == fingerprints.SAMPLES
        error.append(sum(x == y for x, y in zip(prints[i], prints[i + 1], strict=True)) / len(prints[i]) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(error) / len(error)) < 0.02 and (sum(e * e for e in error) / len(error)) ** 0.5 < 0.05 and max(map(abs, error)) < 0.18


def test_shards(docs):
    got = sharding.assign_shards(docs).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(corpus()) and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(expected, key=str)
    copies = [r.shard for r in got if r.doc_id == 6]
    assert len(set(copies)) == 1


def test_propagation_goes_on_while_it_helps(spark):
    # without room only swaps move; after six rounds 2771 rows were outside their hub's fullest shard
    placed = sharding.propagate(spark.range(48_000).selectExpr("id as uid", "id div 2 as hub"), [6000] * 8).collect()
    hubs = collections.defaultdict(collections.Counter)
    for r in placed:
        hubs[r.hub][r.shard] += 1
    assert len(placed) == 48_000 and sum(sum(c.values()) - max(c.values()) for c in hubs.values()) < 1500


def test_mix(docs):
    sizes = collections.Counter()
    for _, t, _, source, _ in corpus():
        sizes[source] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, total = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values())
    low, high = 0.0, float(total)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], weight[s] * level) for s in order) < total else (low, level)
    got = source_mix.report(docs).collect()
    assert len(got) == len(corpus()) and all(0 <= r.taken <= 3 * r.size for r in got)
    by_size = {sizes[s]: min(3 * sizes[s], weight[s] * high) for s in order}
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - by_size[r.source_size]) < 1e-3
        taken[r.source_size] += r.taken
    assert all(abs(taken[n] - t) <= 1 for n, t in by_size.items())
    assert rows_of(source_mix.report(docs)) == sorted(map(tuple, got), key=str)
    assert source_mix.mixed_documents(docs).columns == docs.columns
    # reruns agree however the table is split
    for operator in (source_mix.report, sharding.assign_shards, source_mix.mixed_documents):
        assert rows_of(operator(docs.coalesce(1))) == rows_of(operator(docs.repartition(8)))


def test_personal_data(spark, docs):
    report = {r.doc_id: r for r in pii.report(docs).collect()}
    (number,) = [i for i, t, *_ in corpus() if t and t.startswith("mail Bob")]
    text = corpus()[number][1]
    found = report[number]
    assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == (1, 1, 1, 1)
    shown = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in found.spans.split(","))]
    assert shown == [("email", "Bob.x@mail.example.org"), ("phone", "+1 (017) 555-7713"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111")]
    assert found.base_sha256 == hashlib.sha256(found.spans.encode()).hexdigest() and report[1].spans == ""
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    clean = {r.doc_id: r.text for r in redacted.collect()}
    assert clean[0] is None and clean[number] == "mail <EMAIL> or <PHONE>, 10.0.0.256 and <IP>, <CARD> end" and clean[9] == corpus()[9][1]


def test_disclosing_terms(spark):
    rows = [(i, f"{prose(i, 30)} call agent Zorro at +1 (017) 555-7713 {prose(i + 500, 20)}") for i in range(5)]
    rows += [(100 + i, f"{prose(900 + i, 40)} some Common name {i}") for i in range(40)]
    rows += [(200 + i, f"{prose(700 + i, 20)} near Common +1 (017) 555-7713") for i in range(2)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    terms = [texts[i][int(a) : int(b)] for i in range(5) for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
    assert terms == ["Zorro"] * 5
    assert all(got[i].spans == "" for i in range(100, 140)) and "term" not in got[200].spans


def test_disclosing_terms_of_the_whole_text(spark):
    # the name stands only far from the number, opens a sentence in some texts, and is of another's text too
    rows = [(i, f"{prose(i, 150)} met Zorro there {prose(i + 500, 150)} call +1 (017) 555-7713 {prose(i + 600, 150)}. Zorro left") for i in range(4)]
    rows += [(4, f"Zorro came {prose(5, 100)} +1 (017) 555-7713"), (5, f"{prose(6, 30)} but +1 (017) 555-7713"), (6, None)]
    rows += [(100 + i, f"{prose(900 + i, 40)} some Common name {i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts, got = dict(rows), {r.doc_id: r.spans for r in pii.report(frame).collect()}
    for i in range(6):
        terms = [(int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].split(",")) if k == "term"]
        assert terms == [m.span() for m in re.finditer("Zorro", texts[i])]
    assert all(got[i] == "" for i in range(100, 140))
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert not any("Zorro" in clean[i] for i in range(6)) and clean[6] is None and clean[100] == texts[100]


def test_base_patterns_by_brute_force():
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    right = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and pii._luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15)
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "@", ".", "1", "12", "-", " ", "+", "_", "b.c", "a@b.c", "4111111111111111", "255", "(", "é"]) for _ in range(rng.randint(0, 25)))
        expected = sorted((m.start(), k, m.end()) for k, pattern in enumerate(kinds) for m in re.finditer(pattern, text) if right[k](m[0]))
        assert pii.base_spans(text) == expected, text


def test_licences(spark):
    texts = [None, "", "Under the GNU General-Public License, v3", "CC BY 4.0; cc-by and ccby", "MIT License MIT LICENSE", "gnu genral public licence here", "its license", "x" * 20_000 + " Apache\nLicense"]
    got = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for _, r in sorted(got.items())] == [
        (0, 0, None, None, "", ""), (0, 0, None, None, "", ""), (7, 1, 2, 2, "gpl", "gpl"), (8, 2, 0, 4, "cc-by", "cc-by"),
        (4, 2, 0, 2, "mit", "mit"), (5, 0, None, None, "", "gpl"), (2, 0, None, None, "", ""), (3, 1, 1, 1, "apache", "apache"),
    ]
    assert got[0].score == 0 and got[2].score == 1 and 0.9 < got[5].score < 1


def test_worse_licence_before_a_better_one():
    scanner = license_scan.Scanner(phrases=())
    places = [(a, b, e) for a, b, e, _ in scanner.places("mozila public license mozilla public license mozilla publc licence")]
    assert places == [(0, 21, 1), (22, 44, 0), (45, 66, 2)]
    assert [p[:3] for p in scanner.places("a mozila publc license mozilla public license b")] == [(2, 22, 2), (23, 45, 0)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies, accept.</div><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="content"><h2>Head &amp; line</h2><div class="ad">Buy now, cheap things, here and there.</div>
<p>One paragraph with <i>italics</i>, and <a href=y>links</a>, quite long
 to be seen, yes.<p>Short.<ul><li>Item one<li>Item two</ul><form><p>Sign up</p><input></form></div>
<div class="sidebar"><p>Side text is long enough to look like content, with punctuation, too, really.</p></div>
<section class="comments"><p>I think, that this is a reader comment, of some length, indeed.</p></section>
<footer>Foot</footer><script>if (a<b) x("</p>")</script></body></html>"""


def test_pages(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain &lt;text&gt;"), (4, "w", "plain &lt;text&gt;"), (5, "x", "<p>a<b>c<p>d</p></x><div"), (6, "y", "<p>" + "long text, " * 20_000)]
    got = {r.page_id: r for r in html_extraction.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line One paragraph with italics, and links, quite long to be seen, yes. Short. Item one Item two"
    assert (got[2].text, got[3].text, got[4].text, got[2].url) == ("", "", "plain <text>", None)
    assert got[5].text.startswith("ac d") and got[6].n_chars == len(("long text, " * 20_000).strip())


def test_pages_with_large_parts():
    def text(name, n):
        return " ".join(f"{name} {i}, said so." for i in range(n))

    h, a, b = "A heading", text("first", 65), text("second", 35)
    nested = [
        f"<article><h1>{h}</h1><section><p>{a}</p></section><section><p>{b}</p></section></article>",
        f"<article><h1>{h}</h1><section><h2>Part</h2><p>{a}</p></section><p>{b}</p></article>",
        f"<article><h1>{h}</h1><ul>{''.join(f'<li>{text(str(i), 9)}</li>' for i in range(8))}</ul><p>{b}</p></article>",
        f"<div class=wide><h1>{h}</h1><blockquote><p>{a}</p></blockquote><p>{b}</p></div>",
        f"<div class=wide><h1>{h}</h1><div class=one><p>{a}</p></div><div class=two><p>{b}</p></div></div>",
        f"<h1>{h}</h1><section><p>{a}</p></section><section class=more><p>{b}</p></section>",
        f"<main><h1>{h}</h1><article><p>{a}</p></article><article><p>{b}</p></article></main>",
        f"<article><h1>{h}</h1><section><p>{a}</p><p>{b}</p></section></article>",
    ]
    for body in nested:
        found = html_extraction.blocks(f"<html><body><nav>Home</nav>{body}<div class=sidebar><p>{b}</p></div><footer>Foot</footer></body></html>")
        assert html_extraction.main_blocks(found) == [x for _, _, x, _ in found] and h in found[0][2], body
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(20))
    found = html_extraction.blocks(f"<body><main><p>{a}</p><ul>{links}</ul></main><div class=x><p>{b}</p></div></body>")
    assert html_extraction.main_blocks(found) == [a]
    assert html_extraction.main_blocks(html_extraction.blocks("<p><a href=x>only a link</a></p>")) == []


def test_rows_that_repeat_an_id_or_have_none(spark):
    one, other = prose(70, 40), prose(71, 40)
    rows = [(1, one), (1, other), (2, edited(one, 1, 1)), (None, other), (None, other), (None, prose(72, 40)), (3, None), (3, None), (4, "")]
    got = parity_join.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == sorted([(1, one), (1, other), (None, prose(72, 40)), (3, None), (3, None), (4, "")], key=str)

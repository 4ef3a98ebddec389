import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeloom.llm import chat, decontaminate, licenses, line_dedup, pieces, quality, simhash, suffixes, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _th string, h1 string, score string, kept boolean"


def docs_of(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(ids[k] if ids else k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", 0, "x", "x", "x", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


HARD = [None, "", " ", "\n\n", "a", "A b", "é" * 3, "word " * 4000, "x" * 40000, "a\tb\x0bc", "same text here", "same text here", "#&| $"]


def near_texts(seed=1, n=40):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(rnd.randint(1, 80))]
        out.append(" ".join(w))
        out.append(" ".join([*w[:-1], "tail"]))
    return out


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    texts = HARD + near_texts()
    fps = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {k: (fps[k], root[k]) for k in range(len(texts))}


def test_simhash_dense_group_and_empty(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(1 << 62))
    fps = np.unique(np.array([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 40, (300, 2))], np.uint64))
    links = simhash.spanning_links(fps)
    assert len(links) < len(fps)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    got = simhash.near_duplicates(docs_of(spark, ["a b c", "a b c", None], [None, 5, None])).collect()
    assert Counter((r.doc_id is None, r.component_id) for r in got) == Counter([(False, 5), (True, 5), (True, None)])


def test_pieces_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(2)
    texts = [t for t in HARD] + ["".join(rnd.choice(al) for _ in range(rnd.randint(1, 900))) for al in ("theaniro ", "  \n\tab", "日本語é①😀 x", "aaab", "()[]=;. 12") for _ in range(4)]
    ids = [None if k % 6 == 0 else k // 2 for k in range(len(texts))]  # null and repeated ids
    # a small chunk sends most of them through the parallel scan
    got = pieces.encode(docs_of(spark, texts, ids), chunk=200).collect()
    want = Counter((i, tuple(sp.encode(t or "")), t or "", True) for i, t in zip(ids, texts))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded, r.round_trip) for r in got) == want
    again = pieces.decode(spark.createDataFrame([(1, sp.encode("a b")), (2, []), (3, None)], "doc_id long, ids array<int>")).collect()
    assert [(r.doc_id, r.decoded) for r in again] == [(1, "a b"), (2, ""), (3, "")]
    assert pieces.encode(docs_of(spark, [])).count() == 0
    marked = pieces.encode(docs_of(spark, ["a\u2581b", "a\u2581b " * 40]), chunk=100).collect()
    assert sorted((r.decoded, r.round_trip) for r in marked) == [("a b", False), ("a b " * 40, False)]


def test_pair_fits_against_merging():
    coder = pieces.Coder(pieces.load_model())
    rnd = random.Random(3)
    own = coder._own
    short = [k for k, p in enumerate(own) if p.isascii() and len(p) <= 3 or set(p) == {pieces.BLANK}]
    pairs = [(rnd.randrange(len(own)), rnd.randrange(len(own))) for _ in range(3000)] + [(rnd.choice(short), rnd.choice(short)) for _ in range(9000)]
    a, b = np.array(pairs).T
    assert coder.fit(a, b).tolist() == [coder.merged(own[x] + own[y]) == [own[x], own[y]] for x, y in pairs]


def test_lattice_against_merging():
    coder = pieces.Coder(pieces.load_model())
    rnd = random.Random(4)
    words = ["", "a"] + ["".join(rnd.choice(al) for _ in range(rnd.randint(1, 40))) for al in ("theinos", "ab" + pieces.BLANK, "é日😀\n1", "=") for _ in range(30)]
    words = [w for w in words if pieces.BLANK not in w.lstrip(pieces.BLANK)]
    ids, counts = coder.lattice(words)
    for w, x in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        assert x.tolist() == coder.ids(coder.merged(w))


def _cut(coder, s, n):
    e = [len(s) * k // n for k in range(n + 1)]
    return [(s[max(0, a - coder.longest) : b + coder.longest], a - max(0, a - coder.longest), b - max(0, a - coder.longest)) for a, b in zip(e, e[1:])]


def test_matrices_are_associative():
    coder = pieces.Coder(pieces.load_model())
    m = [coder.transfer(*x) for x in _cut(coder, pieces.prepared("theresa andthere isnothing internationalisation " * 4), 3)]
    assert pieces.compose(pieces.compose(m[0], m[1]), m[2]) == pieces.compose(m[0], pieces.compose(m[1], m[2]))


@pytest.mark.parametrize("text", ["theresa andthere isnothing internationalisation " * 6, "nobreaksatallinthislongword" * 9, "日本語 " * 60])
def test_tree_of_matrices_against_one_sequential_pass(text):
    coder = pieces.Coder(pieces.load_model())
    s = pieces.prepared(text)
    whole = coder.ids(coder.merged(s))
    for n in (1, 2, 3, 5, 8, 13):
        chunks = _cut(coder, s, n)
        matrices = [coder.transfer(*x) for x in chunks]
        got = pieces.scan(matrices)
        reach = {(0, 0): 0.0}
        for m, (a, b) in zip(matrices, got):
            assert a in reach
            reach = pieces.compose({(0, 0): reach}, m).get((0, 0), {})
            assert b in reach
        assert [i for x in coder.between([(*x, a, b) for x, (a, b) in zip(chunks, got)]) for i in x.tolist()] == whole


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|>\\x<|"), (1, 1, "assistant", "a\\"), (1, 1, "assistant", None), (1, 2, None, "z"), (2, None, "sys\ntem\\", "|<"), (2, 1, "assistant", "<\\|"), (None, 1, "user", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", chat.read_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "formatted").collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
    assert got[1].formatted.count(chat.START) == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality_features(spark):
    texts = HARD + ["a b c d e f g h i " * 3, "one two three four five six seven eight nine ten\none two three four five six seven eight nine ten", "l1\nl1\n\nl2 #"]
    got = {r.doc_id: r for r in quality.quality_filter(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        cov = {i + d for v in at.values() if len(v) > 1 for i in v for d in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov)), k
        assert r.base_failed == (len(w) < 20 or 100 * len(cov) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality_filter(docs_of(spark, [])).count() == 0


def test_quality_fences_drop_symbols_and_keep_clean(spark):
    rnd = random.Random(5)
    clean = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rnd.randint(0, 99)) for _ in range(60)) for _ in range(60)]
    junk = [" ".join(w + "&&&" for w in clean[k].split()) for k in range(5)]
    got = {r.doc_id: r.kept for r in quality.quality_filter(docs_of(spark, clean + junk)).collect()}
    assert all(got[k] for k in range(60)) and not any(got[k] for k in range(60, 65))


def _fences_by_hand(rows):
    """rows: (lang, source, metric values by name) -> cutoffs of every group."""
    import math

    out = {}
    bucket = lambda v: 0 if v <= 0 else 1 + math.floor(math.log(v) / math.log(quality.GAMMA))
    value = lambda b: 0 if b == 0 else math.floor(quality.GAMMA ** (b - 1))
    for lang, source in {r[:2] for r in rows}:
        for m, slack in quality.SLACK.items():
            own = [bucket(r[2][m]) for r in rows if r[:2] == (lang, source)]
            wide = [bucket(r[2][m]) for r in rows if r[0] == lang]
            q = {}
            for rank in quality.RANKS:
                weight = lambda b: sum(x <= b for x in own) + quality.PRIOR * sum(x <= b for x in wide) / len(wide)
                q[rank] = value(min(b for b in wide if 20 * weight(b) >= rank * (len(own) + quality.PRIOR)))
            out[lang, source, m] = (
                q[10] - max(quality.SPREAD * (q[10] - q[5]), quality.TAIL * (q[10] - q[2])) - slack if m in quality.TWO_SIDED else -1,
                q[10] + max(quality.SPREAD * (q[15] - q[10]), quality.TAIL * (q[18] - q[10])) + slack,
            )
    return out


def test_quality_fences_against_plain_loops(spark):
    rnd = random.Random(8)
    rows, feats = [], []
    for k in range(400):
        lang, source = rnd.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, None)]) if k else ("en", "rare")
        n = rnd.randint(20, 90)
        chars, symbols, dup, rep = n * rnd.randint(3, 9), rnd.choice([0, 0, 0, rnd.randint(1, 40)]), rnd.randint(0, 3), rnd.choice([0, 0, 8])
        feats.append((k, lang, source, n, chars, symbols, 10, dup, rep, False))
        rows.append((lang, source, {"chars_per_word": 1000 * chars // n, "symbols_per_word": 1000 * symbols // n, "dup_line_share": 1000 * dup // 10, "repeat_share": 1000 * rep // n}))
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    want = _fences_by_hand(rows)
    for r in quality.fences(quality.sketch(spark.createDataFrame(feats, schema))).collect():
        for m in quality.SLACK:
            low, high = want[r.lang, r.source, m]
            assert r[f"hi_{m}"] == high and (m not in quality.TWO_SIDED or r[f"lo_{m}"] == low), (r.lang, r.source, m)


def test_decontamination(spark):
    rnd = random.Random(4)
    items = [(1, " ".join(f"w{rnd.randint(0, 30)}" for _ in range(14))), (2, "short Item"), (3, None), (None, "nameless thing here"), (2, "short item"), (4, "é")]
    texts = HARD + ["pad " * 7 + items[0][1].upper() + " pad", "Short, ITEM! and short item", "nameless thing here", "x é y", " ".join(items[0][1].split()[:9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for block, most in ((decontaminate.BLOCK_BYTES, decontaminate.PASS_BYTES), (40, 1 << 20), (40, 80)):  # one block, many in one pass, many passes
        got = {r.doc_id: r for r in decontaminate.find_contamination(docs_of(spark, texts), bench, block_bytes=block, pass_bytes=most).withColumn("n_hit", decontaminate.hit_words(F.col("spans"))).collect()}
        for k, t in enumerate(texts):
            w, hit, ids = cut(t), set(), set()
            for i, it in items:
                p = cut(it)
                m = min(10, len(p))
                for a in range(len(p) - m + 1 if m else 0):
                    for b in range(len(w) - m + 1):
                        if w[b : b + m] == p[a : a + m]:
                            hit |= set(range(b, b + m))
                            ids |= {i} - {None}
            assert (got[k].n_words, got[k].n_hit, sorted(got[k]["items"])) == (len(w), len(hit), sorted(ids)), k
    assert decontaminate.find_contamination(docs_of(spark, ["a"]), bench.limit(0)).first().spans == []


def test_suffix_dedup_against_brute_force(spark):
    rnd = random.Random(6)
    part = "".join(rnd.choice("abcdé \n") for _ in range(120))
    texts = HARD + [part, "x" + part + "y", part[:49], part[:50], "q" * 30 + part[20:75] + "z" * 30, part + part, part]
    ids = [*range(len(texts) - 2), 3000, 3000]
    first = {}
    for i, t in sorted(zip(ids, texts)):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = Counter()
    for i, t in zip(ids, texts):
        b = (t or "").encode()
        gone = {k + d for k in range(len(b) - 49) if first[b[k : k + 50]] < i for d in range(50)}
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        want[(i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())] += 1
    for block in (suffixes.BLOCK_BYTES, 300):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs_of(spark, texts, ids), block_bytes=block).collect())
        assert got == want
    assert suffixes.remove_repeats(docs_of(spark, [])).count() == 0
    assert [r.n_removed for r in suffixes.remove_repeats(docs_of(spark, [part, part], [None, 1])).collect()] == [0, 0]


def test_suffix_hashes_are_dealt_once(spark, monkeypatch):
    # the shards' answers are written before they are read by two steps, so blocks don't send their hashes twice
    labels, write = [], suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, label: labels.append((label, df._jdf.queryExecution().toString().count("FlatMapGroupsInPandas"))) or write(df, label))
    suffixes.remove_repeats(docs_of(spark, ["a" * 60, "a" * 60]))
    assert [x for x, _ in labels] == ["suffix-masks", "suffix-verdicts"]
    # one grouped step in each of the plan's four forms: neither table is made from the other's lineage
    assert [n for _, n in labels] == [4, 4]


def test_suffix_array():
    import numpy as np

    rng = np.random.default_rng(0)
    for k in range(60):
        t = rng.integers(0, 1 + k % 5, rng.integers(1, 150)).astype(np.uint8)
        b = t.tobytes()
        assert suffixes.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_suffix_array_of_many_symbols():
    rng = np.random.default_rng(1)
    for n, most in ((3000, 1 << 30), (9000, 3000), (6000, 1500)):
        t = np.tile(rng.integers(0, most, n // 3), 3) if most == 1500 else rng.integers(0, most, n)
        t = t.astype(np.int64)
        seq = t.tolist()
        assert suffixes.suffix_array(t).tolist() == sorted(range(n), key=lambda i: seq[i:])
    # a text whose reduced string has more symbols than buckets are walked
    b = rng.integers(97, 123, 30000).astype(np.uint8)
    b[20000:] = b[:10000]
    raw = b.tobytes()
    assert suffixes.suffix_array(b).tolist() == sorted(range(len(raw)), key=lambda i: raw[i : i + 12000])


def test_warc(spark):
    rows = [(1, "http://a b/é", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (70, "u", "WARC/1.1\r\n\r\nfake\n"), (70, "u", "WARC/1.1\r\n\r\nfake\n"), (71, "u", "y" * 100000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.convert_pages(df).collect())
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), i or -1)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        want[(i, len(b), warc.payload_digest(b), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""])] += 1
    assert got == want
    assert warc.convert_pages(df.limit(0)).count() == 0


def test_warc_ids_are_unique_and_hot_digests_split(spark, monkeypatch):
    rows = [(None if k % 2 else 7, "u", "same" if k % 3 else f"page {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for share in (warc.HOT_SHARE, 0):  # a hot digest, none
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        got = warc.convert_pages(df).collect()
        assert len({r.record_id for r in got}) == 400
        assert Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 4) == Counter((i, "response" if i == 7 else "revisit", None if i == 7 else 7) for i, _, h in rows if h == "same")


def test_warc_files_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARC_BYTES", 5000)
    monkeypatch.setattr(warc, "FILE_ARCHIVES", 2)
    df = spark.createDataFrame([(k, "u", f"{k:04d}" * 250) for k in range(100)], "page_id long, url string, html string").coalesce(1)
    archives = warc.pages_to_arc(df).cache()
    assert archives.count() == 20 or archives.count() == 25
    warc.write_warc(archives, warc.revisits(warc.digests(archives), 100), str(tmp_path / "w"))
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 10 and max(sizes) < 2 * 8000
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 100


def test_warc_files_are_compressed(spark, tmp_path):
    pages = [f"<p>{k}</p>" * 2000 for k in range(20)]
    archives = warc.pages_to_arc(spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string")).cache()
    warc.write_warc(archives, warc.revisits(warc.digests(archives), 20), str(tmp_path / "w"))
    assert sum(p.stat().st_size for p in (tmp_path / "w").glob("part-*")) < sum(map(len, pages)) / 10
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == list(enumerate(pages))


def test_arc_versions():
    for v in (1, 2):
        data = warc.arc_block(v, "n") + warc.arc_record(v, "n", b"http://x/ y", "20010909014640", b"a\nb", 9) + warc.arc_record(v, "n", b"", "20010909014640", b"", 9)
        assert [(r["url"], r["body"]) for r in warc.parse_arc(data)] == [(b"http://x/%20y", b"a\nb"), (b"-", b"")]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_block(1, "n") + warc.arc_record(2, "n", b"u", "2", b"", 0)))


def test_toxicity(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ten") for b in ("ka", "su", "pen", "dro")]
    texts, labels = [], []
    for k in range(300):
        w = [rnd.choice(words) for _ in range(30)]
        bad = k % 3 == 0
        if bad:
            w[rnd.randint(0, 29)] = "vile"
        texts.append(" ".join(w))
        labels.append((k, int(bad)))
    labels += [(0, None), (None, 1), (999, 1)]
    monkeypatch.setattr(toxicity, "STEPS", 80)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.classify(docs_of(spark, texts + HARD), lab, docs_of(spark, texts)).collect()
    got = {r.doc_id: r for r in rows}
    assert sum(got[k].predicted == int(k % 3 == 0) for k in range(300)) >= 294
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert got[300].predicted == got[301].predicted == 0
    assert toxicity.classify(docs_of(spark, ["a"]), lab.limit(0)).first().score == 0


def _plain_logit(net, text):
    """The forward pass in plain loops, from the hashed rows of each word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    vec = []
    for w in words:
        rows, weight, _ = toxicity.hashed_rows([w])
        vec.append([sum(float(weight[k]) * float(net.emb[r][d]) for k, r in enumerate(rows)) for d in range(toxicity.DIM)])
    z = net.const
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            top = 0.0
            for a in range(len(words) - width + 1):
                top = max(top, float(net.bias[i * toxicity.FILTERS + f]) + sum(vec[a + k][d] * float(net.conv[i][k][d][f]) for k in range(width) for d in range(toxicity.DIM)))
            z += top * float(net.out[i * toxicity.FILTERS + f])
    return z


def test_toxicity_forward_pass_against_plain_loops():
    net = toxicity.ConvNet.fresh(np.random.default_rng(3))
    net.bias[:] = np.random.default_rng(4).normal(0, 0.1, net.bias.shape)
    net.const = 0.3
    texts = ["one two three four", "", None, "x", "größe Ñandú ça va", "two words"]
    z, langs = net.logits(texts)
    assert langs == ["other", "other", "other", "other", "de", "other"]
    assert np.allclose(z, [_plain_logit(net, t) for t in texts], atol=1e-4)


def test_toxicity_word_hashing_against_plain_loops():
    m = 1 << 64
    prime = 0x9E3779B97F4A7C15
    row = lambda key: ((key ^ (key >> 31)) * prime % m) >> (64 - toxicity.ROWS.bit_length() + 1)
    for word in ("a", "four", "größe", "internationally"):
        raw = b"<" + word.encode() + b">"
        total = 0
        for p, c in enumerate(raw):
            x = (c + 1) * (prime * (2 * p + 1) % m) % m
            total = (total + (x ^ (x >> 29)) * prime) % m
        want = [(row(total), 1.0)]
        for g in toxicity.GRAMS:
            n = len(raw) - g + 1
            want += [(row((int.from_bytes(raw[k : k + g], "big") ^ (g << 56)) * prime % m), 1 / n) for k in range(n)]
        rows, weight, _ = toxicity.hashed_rows([word])
        assert rows.tolist() == [r for r, _ in want] and np.allclose(weight, [w for _, w in want])


def test_toxicity_gradient_against_differences():
    rng = np.random.default_rng(5)
    net = toxicity.ConvNet.fresh(rng)
    vec = rng.normal(0, 1, (9, toxicity.DIM)).astype(np.float32)
    local, stop, y = np.array([0, 1, 2, 3, 4, 5, 0, 6, 7, 8, 2]), np.array([4, 5, 11]), np.array([1, 0, 1])

    def loss():
        best, _ = net.pooled(vec, local, stop)
        z = (best @ net.out + net.const).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = toxicity._gradient(net, vec, local, stop, y)
    for param, grad in ((net.out, g["out"]), (net.bias, g["bias"]), (net.conv[2], g["conv"][2]), (vec, g["vec"])):
        flat, want = param.reshape(-1), np.asarray(grad).reshape(-1)
        for k in rng.choice(len(flat), 12, replace=False):
            was = flat[k]
            flat[k] = was + 2e-3
            up = loss()
            flat[k] = was - 2e-3
            down = loss()
            flat[k] = was
            assert abs((up - down) / 4e-3 - want[k]) < 3e-3


def test_toxicity_thresholds_against_every_cutoff():
    rnd = random.Random(9)
    for _ in range(20):
        y = np.array([rnd.random() < 0.4 for _ in range(40)]).astype(np.int64)
        z = np.array([rnd.gauss(1.5 * k, 1) for k in y])
        cost = lambda c: sum(a < c for a in z[y == 1]) / max(1, y.sum()) + toxicity.FALSE_WEIGHT * sum(a >= c for a in z[y == 0]) / max(1, (1 - y).sum())
        assert abs(cost(toxicity._threshold(z, y)) - min(map(cost, [*z, z.min() - 1, z.max() + 1]))) < 1e-9


def test_toxicity_learns_from_rows_outside_the_sample(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ten") for b in ("ka", "su", "pen", "dro")]
    texts = [" ".join(rnd.choice(words) for _ in range(20)) + (" vile" if k % 3 == 0 else "") for k in range(600)]
    # the sample is full with a tenth of the rows; a second toxic word is only in rows that it hasn't drawn
    monkeypatch.setattr(toxicity, "STEPS", 60)
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    drawn = set(toxicity._sample(docs, labels, 30, 1 << 20)[0])
    texts = [t.replace("vile", "zorgh") if k % 2 and k not in drawn else t for k, t in enumerate(texts)]
    net = toxicity.learn(docs_of(spark, texts), labels, per_class=30)
    sample = toxicity.train(*toxicity.training_rows(docs_of(spark, texts), labels, per_class=30))
    odd = [t for k, t in enumerate(texts) if "zorgh" in t]
    miss = lambda model: float((model.scores(odd) < 0.5).mean())
    assert miss(net) < 0.1 < miss(sample)
    assert float((net.scores([t for k, t in enumerate(texts) if k % 3]) >= 0.5).mean()) < 0.05


def test_toxicity_nets_follow_the_texts_not_the_partitions(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    texts = [f"word{k % 7} more" + (" vile" if k % 3 == 0 else "") for k in range(400)]
    monkeypatch.setattr(toxicity, "STEPS", 5)
    tasks, real = [], Frame.mapInArrow
    monkeypatch.setattr(Frame, "mapInArrow", lambda self, *a, **b: (tasks.append(self.rdd.getNumPartitions()), real(self, *a, **b))[1])
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int")
        toxicity.learn(docs_of(spark, texts), labels, per_class=30)
        few = tasks[0]
        monkeypatch.setattr(toxicity, "TASK_BYTES", 1000)
        toxicity.learn(docs_of(spark, texts), labels, per_class=30)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # each task of the first pass makes a net of some MB; a few KB of text in 24 partitions are one task's, more text is dealt to more
    assert few == 1 < tasks[2] < 24


def test_toxicity_sample_bounds(spark):
    texts = ["long " * 3000, *["short text"] * 30, None]
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, toxic int")
    kept = [k for k in range(len(texts)) if __import__("zlib").crc32(str(k).encode()) % 5]
    got, y = toxicity.training_rows(docs_of(spark, texts), labels)
    assert sorted(got) == sorted(texts[k] or "" for k in kept) and sum(y) == sum(k % 2 for k in kept)
    got, _ = toxicity.training_rows(docs_of(spark, texts), labels, max_bytes=100)
    assert all(len(t) < 100 for t in got) and len(got) <= 22


def test_line_dedup(spark):
    texts = [f"Common Line \nown {k}\n\n" for k in range(10)] + ["common line\n" * 3, "\tCOMMON LINE", None, "", "rare\nrare"] + ["nine"] * 9
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    df = Counter(k for t in texts for k in set(keys(t)))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        pairs = list(zip((t or "").split("\n"), keys(t)))
        kept = [x for x, k in pairs if not (k and df[k] >= 10)]
        assert got[i] == (len(pairs), len(pairs) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_levels_hot_keys_and_odd_ids(spark, monkeypatch):
    rnd = random.Random(11)
    texts = ["hot line\n" + "\n".join(f"l{rnd.randint(0, 60)}" for _ in range(rnd.randint(0, 6))) for _ in range(120)]
    ids = [None if k % 4 == 0 else k // 3 for k in range(len(texts))]  # null and repeated ids
    df = Counter(k for t in texts for k in set(t.split("\n")) if k)
    want = Counter()
    for i, t in zip(ids, texts):
        kept = [x for x in t.split("\n") if not (x and df[x] >= 10)]
        want[i, len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept)] += 1
    for share in (line_dedup.HOT_SHARE, 8, 0):  # every key hot, one key hot, none
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        # nine batches in runs of two: compaction goes up several levels
        got = line_dedup.dedup_lines(docs_of(spark, texts, ids), batches=9, fanout=2)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want
    own = docs_of(spark, texts, ids)
    assert line_dedup.drop_lines(own, line_dedup.frequent_lines(own)).select("_th").distinct().collect() == [("x",)]


def test_licenses(spark):
    bags = licenses.template_bags()
    texts = HARD + ["intro\nReleased under the MIT License.\nend", licenses.TEMPLATES["apache-2.0-header"].replace(" use ", "\nuse ").upper(), "released under the mit licence"]
    got = {r.doc_id: {(m.license, round(m.dice, 9)) for m in r.matches} for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        norm = re.sub(licenses._SEPARATORS, " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = set()
        for u in {*norm.split("\n"), *(p.replace("\n", " ") for p in re.split(r"\n *\n[ \n]*", norm)), norm.replace("\n", " ")}:
            w = u.split()
            b = {f"{x} {y}" for x, y in zip(w, w[1:])}
            want |= {(k, round(2 * len(b & set(v)) / (len(b) + len(v)), 9)) for k, v in bags.items() if b and 2 * len(b & set(v)) / (len(b) + len(v)) >= 0.8}
        assert got[i] == want, i
    assert any(k == "mit" for k, _ in got[len(HARD)]) and got[len(HARD) + 1]


def test_snippets_that_agree_beyond_their_own_end():
    # the common prefix of rows 0 and 2 runs on into rows 1 and 3, past the length that is compared
    g = np.random.default_rng(1)
    tail, head = g.integers(97, 123, 40), g.integers(97, 123, 60)
    parts = [np.r_[g.integers(97, 123, 20), tail], np.r_[head, [97]], np.r_[g.integers(97, 123, 20), tail], np.r_[head, [98]]]
    rows = np.full((4, suffixes.WIDEST), suffixes.PAD, np.uint8)
    for k, x in enumerate(parts):
        rows[k, : len(x)] = x
    group, cell = suffixes.repeated_strings(rows, np.array([len(x) for x in parts]))
    got = {}
    for a, b in zip(group.tolist(), cell.tolist()):
        got.setdefault(a, set()).add(b)
    want = {}
    for k, x in enumerate(parts):
        for i in range(len(x) - suffixes.LENGTH + 1):
            want.setdefault(rows[k, i : i + suffixes.LENGTH].tobytes(), set()).add(k * suffixes.SPAN + i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_licenses_inside_other_words(spark):
    pad = " ".join(f"several{k} words{k} that{k} stand{k} before{k} and{k} after{k} the{k} notice{k}" for k in range(9))
    header = licenses.TEMPLATES["apache-2.0-header"]
    cut = [header.index("You may obtain"), header.index("Unless required")]
    parts = "\n\n".join((header[: cut[0]], header[cut[0] : cut[1]], header[cut[1] :]))
    gpl = licenses.TEMPLATES["gpl-3.0-header"].replace(" GNU", "\nGNU")
    texts = [
        "This small library is fast and well tested. Released under the MIT License. Contact the maintainers by mail.",
        f"Copyright 2020 A Name\n\n{parts}\n\nbody\n{pad}\n{pad}\n{pad}",
        f"Copyright 2021 {pad}\n{gpl}\n{pad} {pad}",
        f"{pad} {licenses.TEMPLATES['mpl-2.0']} {pad}\n\n{pad} Released\nunder\n\nthe MIT License. {pad}",
        f"{pad} the license of the source code is under another license {pad}",
        f"{pad} released under the mit",
    ]
    got = {r.doc_id: {m.license: m for m in r.matches} for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [set(got[k]) for k in range(len(texts))] == [{"mit"}, {"apache-2.0-header"}, {"gpl-3.0-header"}, {"mpl-2.0", "mit"}, set(), set()]
    assert got[0]["mit"].unit == "released under the mit license"
    assert [got[k][name].dice for k, name in ((0, "mit"), (1, "apache-2.0-header"), (2, "gpl-3.0-header"), (3, "mpl-2.0"), (3, "mit"))] == [1] * 5


def best_license_window(words, template, threshold):
    """(dice, size, start) of the best window of a template's words by trying all of them; None below the threshold."""
    high, pairs = (2 - threshold) / threshold + 1e-9, lambda w: list(zip(w, w[1:]))
    g, bag, span = pairs(words), set(pairs(template)), len(template) - 1
    limit, last, best = int(span * high), len(g) - span, None
    hit = [x in bag for x in g] + [False]
    for i in sorted({min(k, last) for k in range(len(g)) if hit[k] and not (k and hit[k - 1])}):
        for n in range(span, min(limit, len(g) - i) + 1):
            if n in (span, limit) or hit[i + n - 1] and not hit[i + n]:
                part = set(g[i : i + n])
                found = (2.0 * len(part & bag) / (len(part) + len(bag)), -n, -i)
                best = max(best, found) if best else found
    return best if best and best[0] >= threshold else None


def test_license_windows_against_all_windows(spark):
    rng = random.Random(11)
    seen = 0
    for length in (7, 12, 40):
        template = [rng.choice("abcdefghij") + str(k % 9) for k in range(length)]
        texts = []
        for _ in range(60):
            copy = [w if rng.random() < 0.95 else "zz" for w in template]
            at = rng.randrange(length)
            pad = [rng.choice(template + ["q", "r"]) for _ in range(rng.randrange(3 * length))]
            words = pad + copy[:at] + [rng.choice("qrs")] * rng.randrange(3) + copy[at:] + [rng.choice(template) for _ in range(rng.randrange(3 * length))]
            # a word of its own keeps the whole text, the only unit, from matching
            texts.append(" ".join([f"own{k}" for k in range(3 * length)] + words))
        got = {r.doc_id: r.matches for r in licenses.scan_licenses(docs_of(spark, texts), {"t": " ".join(template)}).collect()}
        for k, text in enumerate(texts):
            words = text.split(" ")
            want = best_license_window(words, template, licenses.THRESHOLD)
            assert [(m.dice, m.unit) for m in got[k]] == ([(want[0], " ".join(words[-want[2] : -want[2] - want[1] + 1]))] if want else []), (length, k)
            seen += want is not None
    assert seen > 30


def test_license_windows_in_long_prose(spark):
    whole = re.sub(r"\s+", " ", licenses.TEMPLATES["gpl-3.0-text"]).split()
    rng = random.Random(3)
    noisy = " ".join("zz" if rng.random() < 0.03 else w for w in whole)
    # words of its own keep the whole text, the only unit, from matching
    text = " ".join([*(f"own{k}" for k in range(9000)), *whole[2500:], noisy, *whole[:2500]])
    got = {m.license: m.dice for m in licenses.scan_licenses(docs_of(spark, [text + " " + re.sub(r"\s+", " ", licenses.TEMPLATES["mpl-2.0-text"])])).collect()[0].matches}
    assert got["gpl-3.0-text"] >= 0.9 and got["mpl-2.0-text"] >= 0.99


def test_license_anchors_are_in_every_match():
    bags = licenses.template_bags()
    anchors = set(licenses.anchor_words(bags))
    for bag in bags.values():
        assert sum(not anchors & set(b.split()) for b in bag) < len(bag) * licenses.THRESHOLD / (2 - licenses.THRESHOLD)


def test_whole_license_texts(spark):
    pad = " ".join(f"word{k}" for k in range(3000))
    names = ["mit-text", "bsd-2-clause", "bsd-3-clause", "apache-2.0-text", "mpl-2.0-text", "gpl-3.0-text", "gpl-3.0-notice", "unlicense-text"]
    one = [re.sub(r"\s+", " ", licenses.TEMPLATES[n]) for n in names]
    texts = [t for n in one for t in (n, f"Copyright 2020 A Name. {n}", f"{pad}\n{n} {pad}")]
    got = {r.doc_id: r.matches for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    for k in range(len(texts)):
        best = max(got[k], key=lambda m: m.dice)
        assert best.license == names[k // 3] and best.dice > 0.9, k
    assert "provided as is without warranty" in got[0][0].unit

"""Line dedup, URL filter, language ID, mixing and media."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import make, words
from pyspark.sql import functions as F

from streetweave.llm import langid, line_dedup, media_mpeg, mixing, url_filter


def brute_lines(rows, least=line_dedup.MIN_DOCS, lead=line_dedup.LEAD):
    """(doc_id, kept text) of each row."""
    norm = lambda line: tuple(("<*>" if re.search("[0-9]", t) else t) for t in re.split("[\x20\x09\x0b-\x0d]+", line) if t)
    lines = [[norm(x) for x in t.split("\n")] if t is not None else [] for _, t in rows]
    leaf = lambda x: (len(x), x[:lead])
    leaves = Counter(leaf(x) for ls in lines for x in ls if x)
    crowded = [x for ls in lines for x in ls if x and leaves[leaf(x)] >= least]
    seen = Counter((leaf(x), p, t) for x in crowded for p, t in enumerate(x))
    template = {}
    for x in crowded:
        keep = [t != "<*>" and (p < lead or seen[leaf(x), p, t] >= least) for p, t in enumerate(x)]
        general = len(x) > lead and sum(keep[lead:]) * 2 >= len(x) - lead
        template[x] = (leaf(x), tuple(t if k else "<*>" for t, k in zip(x, keep, strict=True)) if general else ("own", *x))
    first = {}
    for (d, _), ls in zip(rows, lines, strict=True):
        for x in ls:
            if d is not None and x in template:
                first[template[x]] = min(first.get(template[x], d), d)
    size = lambda x: len(" ".join(x).encode())

    def kind(ls):
        """The document that most of the text comes from, or the text itself."""
        parts = Counter()
        for x in ls:
            if x in template and template[x] in first:
                parts[first[template[x]]] += size(x)
        return next((d for d, n in parts.items() if 5 * n >= 4 * sum(map(size, ls))), tuple(ls))

    kinds = defaultdict(set)
    for ls in lines:
        for x in ls:
            if x in template:
                kinds[template[x]].add(kind(ls))
    gone = {t for t, k in kinds.items() if len(k) >= least}
    out = []
    for (d, t), ls in zip(rows, lines, strict=True):
        kept = [r for r, x in zip((t or "").split("\n"), ls) if template.get(x) not in gone or first.get(template[x]) == d]  # noqa: B905
        out.append((d, None if t is None else "\n".join(kept)))
    return out


def test_recurring_lines(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(1)
    rows = []
    for i in range(80):
        body = [words(rng, 12) for _ in range(4)]
        if i % 3 == 0:
            body.insert(rng.randint(0, 4), f"Page {i} of the report on file")
        if i % 4 == 0:
            body.insert(rng.randint(0, 4), f"All rights are held by {words(rng, 1)} and its owners")
        if i % 5 == 0:
            body.insert(rng.randint(0, 4), "")
        rows.append((i, "\n".join(body), "en", "a"))
    rows += [(100 + i, rows[7][1], "en", "a") for i in range(6)]  # copies of a whole document stay as they are
    docs = make(spark, rows)
    out = line_dedup.drop_recurring_lines(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter(brute_lines([r[:2] for r in rows]))
    kept = {r.doc_id: r.text for r in out.collect()}
    assert "Page 0 of" in kept[0] and "Page 3 of" not in kept[3] and "All rights" not in kept[8]
    assert kept[103] == rows[7][1]
    edge = line_dedup.drop_recurring_lines(edge_docs, counts=True)
    assert Counter((r.doc_id, r.text) for r in edge.collect()) == Counter(brute_lines([r[:2] for r in edge_rows]))
    assert line_dedup.drop_recurring_lines(no_docs, counts=True).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5])
@pytest.mark.parametrize("blank", [False, True])
def test_blocks_of_lines(spark, block, blank):
    """Blocks that 60 documents share go from all but one, at any length, between blank lines too."""
    rng = random.Random(block)
    notice = [words(rng, 10) for _ in range(block)]
    gap = [""] if blank else []
    rows = [(i, "\n".join([words(rng, 12), *gap, *notice, *gap, words(rng, 12)]), "en", "a") for i in range(60)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(make(spark, rows), counts=True).collect()}
    own = {i: [x for x in t.split("\n") if x not in notice] for i, t, *_ in rows}
    assert {i: r.text for i, r in got.items()} == {i: t if i == 0 else "\n".join(own[i]) for i, t, *_ in rows}
    assert sum(r.n_dropped for r in got.values()) == 59 * block
    assert {i: r.text for i, r in got.items()} == dict(brute_lines([r[:2] for r in rows]))


def test_copies_keep_their_lines(spark):
    """Exact copies, and copies with one changed line, aren't recurring lines; a notice in them is."""
    rng = random.Random(6)
    body = [words(rng, 12) for _ in range(12)]
    rows = [(i, "\n".join(body), "en", "a") for i in range(5)]
    rows += [(10 + i, "\n".join([*body[:i], words(rng, 12), *body[i + 1 :]]), "en", "a") for i in range(12)]
    rows += [(30 + i, "\n".join([words(rng, 12), body[3], words(rng, 12)]), "en", "a") for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(make(spark, rows)).collect()}
    want = {i: t if i == 0 else "\n".join(x for x in t.split("\n") if x != body[3]) for i, t, *_ in rows}
    assert got == want == dict(brute_lines([r[:2] for r in rows]))


def test_lines_that_share_only_their_start_stay(spark):
    rng = random.Random(7)
    ends = ["dark night", "long week", "nice day", "cold lake", "small town"]
    rows = [(i, f"{words(rng, 12)}\nIt was a {end}\n{words(rng, 12)}", "en", "a") for i, end in enumerate(ends)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(make(spark, rows)).collect()}
    assert got == {r[0]: r[1] for r in rows}


def test_a_text_of_very_many_lines(spark):
    """200,000 lines, half of them of templates that recur: a search of the lost lines for each line would take hours."""
    rng = random.Random(8)
    common = [f"{w} of the common report and file" for w in words(rng, 400).split()]
    many = "\n".join(x for i in range(100_000) for x in (rng.choice(common), f"own{chr(97 + i % 26)} {'abc' * (i % 9)} z{'q' * (i % 50)}"))
    rows = [(i, "\n".join([words(rng, 12), *common, words(rng, 5000)]), "en", "a") for i in range(4)] + [(9, many, "en", "a")]
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(make(spark, rows), counts=True).select("doc_id", "n_lines", "n_dropped").collect()}
    assert time.time() - began < 120
    assert got[9].n_lines == 200_000 and got[9].n_dropped >= 100_000


def test_line_dedup_is_native(spark, no_docs):
    plan = line_dedup.drop_recurring_lines(no_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a.example.com/en/1?x#y", ("a.example.com", "/en/1", "example.com/en/", "block")),
        ("https://WWW.Example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")),
        ("http://example.com", ("example.com", "", None, "allow")),
        ("http://example.com?q=/en/", ("example.com", "", None, "allow")),
        ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        ("http://b.net/es/x", ("b.net", "/es/x", "net/es/", "block")),
        ("http://b.net/ES/x", ("b.net", "/ES/x", None, "allow")),
        ("http://net/es/", ("net", "/es/", "net/es/", "block")),
        ("no scheme", ("", "", None, "allow")),
        ("://", ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("http://" + "a." * 300 + "com/" + "p" * 5000, ("a." * 300 + "com", "/" + "p" * 5000, "com/", "allow")),
    ],
)
def test_urls(tmp_path, url, want):
    url_filter.write_rules(str(tmp_path / "rules"), RULES)
    index = url_filter.RuleIndex(str(tmp_path / "rules"))
    host, path = url_filter.split_url(url)
    rule, verdict = index.judge([(host, path)])[0]
    assert (host, path, rule, verdict or "allow") == want


def test_hosts_of_very_many_labels(tmp_path):
    url_filter.write_rules(str(tmp_path / "rules"), RULES)
    index = url_filter.RuleIndex(str(tmp_path / "rules"))
    tracemalloc.start()
    assert index.judge([("a." * 100_000 + "example.com", "/en/" + "p" * 100_000)]) == [("example.com/en/", "block")]
    assert index.judge([("." * 100_000 + "com", "/"), ("." * 100_000, "/")]) == [("com/", "allow"), (None, None)]
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_url_rows_and_collisions(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "http://x.com/a", "h", "r"), (1, "http://x.com/a", "h", "r"), (None, None, None, None)], "page_id long, url string, host string, rule string")
    got = Counter(map(tuple, url_filter.filter_urls(pages, RULES).collect()))
    assert got == Counter({(1, "x.com", "/a", "com/", "allow"): 2, (None, "", "", None, "allow"): 1})
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert url_filter.filter_urls(pages, []).where("rule IS NOT NULL").count() == 0
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)  # all digests alike
    url_filter.write_rules(str(tmp_path / "r"), RULES)
    assert url_filter.RuleIndex(str(tmp_path / "r")).judge([("a.net", "/es/1"), ("a.org", "/")]) == [("net/es/", "block"), (None, None)]


def test_language_accuracy(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = langid.identify(docs, langid.fit(docs, ~held)).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    profiles = langid.fit(edge_docs)
    got = {r.doc_id: r for r in langid.identify(edge_docs, profiles).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 5)] == ["und"] * 4 and got[0].score == 0
    assert got[8].lang_pred == "fr" and got[6].lang_pred == "en"
    kept = langid.reject_foreign(edge_docs, 0.0)
    assert kept.columns == edge_docs.columns and not {0, 1, 2, 5} & {r.doc_id for r in kept.collect()}
    assert langid.reject_foreign(no_docs, 0.3).count() == 0
    assert {r.lang_pred for r in langid.identify(edge_docs, {}).collect()} == {"und"}


def brute_grams(text, ranks=langid.RANKS):
    """The most frequent runs of one to three code points in order, by plain counting."""
    words_ = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    flat = " " + " ".join(words_) + " "
    found = Counter(c for c in flat if c != " ")
    for n in (2, 3):
        found.update(flat[i : i + n] for i in range(len(flat) - n + 1) if words_)
    order = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(found, key=lambda g: (-found[g], order(g))), found


def test_language_against_brute_force(spark, edge_rows):
    """Profiles and sums of rank differences in plain Python; languages that tie go by name."""
    rng = random.Random(13)
    syllables = {"en": ("the", "an", "er", "ing"), "fr": ("é", "ou", "que", "an"), "zz": ("xk", "qz", "vv", "é")}
    rows = [(100 + i, words(rng, rng.randint(1, 60), syllables[lang]) + rng.choice(["", " 12!", "\nÉ"]), lang, "a") for i in range(90) for lang in syllables]
    # Two languages of the same text tie, and n-grams of one count tie by code point.
    rows += [(1000, "same words here", "b1", "a"), (1001, "same words here", "b0", "a"), (1002, "zyx cba", None, None)]
    rows = [*rows, *edge_rows]
    learned = {}
    for _, t, lang, _ in rows:
        if lang is not None:
            learned.setdefault(lang, Counter()).update(brute_grams(t)[1])
    order = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    profiles = {lang: sorted(c, key=lambda g: (-c[g], order(g)))[: langid.RANKS] for lang, c in learned.items()}
    rank = {lang: {g: i for i, g in enumerate(p)} for lang, p in profiles.items()}
    want = Counter()
    for i, t, *_ in rows:
        own = brute_grams(t)[0][: langid.RANKS]
        far = {lang: sum(abs(r[g] - k) if g in r else langid.RANKS for k, g in enumerate(own)) for lang, r in rank.items()}
        best = min(sorted(far), key=far.get)
        want[i, best if own else "und", round(1 - far[best] / (langid.RANKS * len(own)), 9) if own else 0.0] += 1
    docs = make(spark, rows)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, langid.fit(docs)).collect())
    assert got == want


def test_foreign_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(4)
    greek = "και το που της στην από για με θα δεν είναι στο αυτό " * 5
    more = make(spark, [(-1, greek, None, "a"), (-2, "Привет мир", None, "a"), (-3, "".join(rng.choice("bcdfghjklmnpqrstvwxz     ") for _ in range(3000)), None, "a"), (-4, "Ok.", None, "a")]).select(*docs.columns)
    kept = {r.doc_id: r.lang for r in langid.reject_foreign(docs.unionByName(more), short=64).collect()}
    assert set(kept) == {r.doc_id for r in docs.collect()} | {-4} and kept[-4] is not None
    # A language that the model never saw goes.
    few = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    left = langid.reject_foreign(few).where("doc_id >= 0").select("doc_id").join(docs, "doc_id")
    long = F.expr("lang = 'de' AND n_chars > 400")
    assert left.where(long).count() <= 0.05 * docs.where(long).count() and left.where("lang <> 'de'").count() == docs.where("lang <> 'de'").count()


def test_blocks_of_a_long_text_count_alike(monkeypatch):
    text = words(random.Random(5), 300) + " 12 ÉÉ--x  y"
    whole = langid.grams(text)
    for block in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "BLOCK", block)
        keys, counts = langid.grams(text)
        assert keys.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()


def reshare(sizes, weights=(1, 2, 3), most=3):
    """Targets by rounds: those above their cap are held there, the rest share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark, edge_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(1, 80)), "en", rng.choices([None, "a", "b", "c", "d", "é"], [2, 9, 3, 1, 1, 1])[0]) for i in range(900)]
    docs = make(spark, rows)
    got = {r.doc_id: r for r in mixing.plan_mix(docs).collect()}
    sizes = defaultdict(int)
    for i, t, _, s in rows:
        assert got[i].size == len(t.split())
        sizes[s] += got[i].size
    want, taken = reshare(sizes), defaultdict(int)
    for r in got.values():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 80
    again = {r.doc_id: r.copies for r in mixing.plan_mix(docs.repartition(7)).collect()}
    assert again == {i: r.copies for i, r in got.items()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: r.copies for i, r in got.items() if r.copies})
    edge = mixing.plan_mix(edge_docs).collect()
    assert len(edge) == edge_docs.count() and all(r.size == 0 for r in edge if r.doc_id in (0, 1, 2))
    assert mixing.mix(edge_docs).columns == edge_docs.columns
    assert mixing.plan_mix(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_pareto_ranks(spark, monkeypatch):
    """Inclusion in proportion to size, ranks by odds over odds, in plain Python; the bins' size changes nothing."""
    rng = random.Random(16)
    rows = [(i, words(rng, rng.choice([0, 3, 10, 40, 41, 300])), "en", rng.choice("ab")) for i in range(400)] + [(1000, words(rng, 9000), "en", "a")]
    docs = make(spark, rows)
    plan = {r.doc_id: r for r in mixing.plan_mix(docs, weights=(1, 5)).collect()}
    for source in "ab":
        mine = [r for r in plan.values() if r.source == source]
        whole = int(mine[0].target // mine[0].source_size)
        rest = mine[0].target - whole * mine[0].source_size
        largest = rest if sum(r.size for r in mine if r.size <= rest) >= rest else math.inf
        drawn = [r for r in mine if 0 < r.size <= largest]
        coarse = lambda n: n >> max(n.bit_length() - 6, 0) << max(n.bit_length() - 6, 0)
        lo, hi = 0.0, 1.0
        for _ in range(200):  # the factor at which the expected words are what is left
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if sum(min(1, lam * coarse(r.size)) * r.size for r in drawn) < rest else (lo, lam)
        ranked = []
        for r in drawn:
            u = (int(hashlib.md5(f"42:{r.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = min(1.0, lam * coarse(r.size))
            ranked.append((0.0 if p > 1 - 1e-9 else u / (1 - u) / (p / (1 - p)), r.doc_id, r.size))
        sums, taken = 0, set()
        for _, i, n in sorted(ranked):
            if sums + n / 2 <= rest:
                taken.add(i)
            sums += n
        assert {r.doc_id: r.copies for r in mine} == {r.doc_id: whole + (r.doc_id in taken) for r in mine}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 150
        if 0 < len(taken) < len(ranked):
            share = lambda f: sum(i in taken for _, i, n in ranked if f(n)) / max(1, sum(f(n) for _, _, n in ranked))
            assert share(lambda n: n >= 300) >= share(lambda n: n <= 10)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 0)
    assert {r.doc_id: r.copies for r in mixing.plan_mix(docs, weights=(1, 5)).collect()} == {i: r.copies for i, r in plan.items()}


def test_many_sources(spark):
    rows = [(i, "a b c " * (i % 7 + 1), "en", f"s{i % 300}") for i in range(900)]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = reshare(sizes)
    got = {r.source: r.target for r in mixing.plan_mix(make(spark, rows)).collect()}
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_mpeg_round_trip():
    rng = random.Random(7)
    for n in (0, 1, 191, 192, 193, 767, 768, 769, 50_000):
        raw = rng.randbytes(n)
        payload = media_mpeg.pad(raw)
        assert len(payload) % 192 == 0 and payload.startswith(raw) and len(payload) - n <= 192
        media = media_mpeg.encode(payload, n)
        s = media_mpeg.decode(media)
        assert s.payload == payload and s.crc_errors == s.skipped == 0
        assert s.vbr_frames == len(s.offsets) and s.samples == 1152 * len(s.offsets) and int(s.tags["n_bytes"]) == n
        assert all(media[o] == 0xFF and media[o + 1] == 0xFA for o in s.offsets)


def test_mpeg_faults():
    media = media_mpeg.encode(media_mpeg.pad(b"text " * 500), 2500)
    s = media_mpeg.decode(media)
    broken = bytearray(media)
    broken[s.offsets[1] + 8] ^= 1  # in the side information, which the checksum covers
    assert media_mpeg.decode(bytes(broken)).crc_errors == 1
    at = s.offsets[2]
    junk = media_mpeg.decode(media[:at] + b"\xff\xfa\x00 junk \xff" + media[at:])
    assert junk.payload == s.payload and junk.skipped > 0
    for at in (s.offsets[1], s.offsets[2], len(media)):  # a header that nothing follows, after the first frame too
        false = media_mpeg.decode(media[:at] + b"\xff\xfa\x64\xc0" + b"junk" * 30 + media[at:])
        assert false.payload == s.payload and len(false.offsets) == len(s.offsets) == false.vbr_frames and false.crc_errors == 0 and false.skipped == 124
    tagged = media_mpeg.decode(media + b"TAG" + bytes(125))
    assert tagged.payload == s.payload and tagged.skipped == 128
    head = b"\xff\xfb\x64\xc0"  # a frame without checksum, with a VBRI table
    frame = head + bytes(32) + b"VBRI" + bytes(6) + (480).to_bytes(4, "big") + (1).to_bytes(4, "big")
    vbri = media_mpeg.decode((frame + bytes(240 - len(frame)) + head + bytes(236)))
    assert (vbri.vbr_bytes, vbri.vbr_frames, vbri.offsets) == (480, 1, [240])
    assert media_mpeg.decode(b"").offsets == [] and media_mpeg.decode(b"\xff" * 100).offsets == []
    # CRC-16 of the format over known bytes, bit by bit from its polynomial.
    assert media_mpeg.crc16(b"") == 0xFFFF and media_mpeg.crc16(b"123456789") == 0xAEE7


def test_media_rows(spark, edge_docs, edge_rows, no_docs):
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in media_mpeg.to_mpeg(edge_docs).collect())
    want = []
    for r in edge_rows:
        raw = (r[1] or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((r[0], len(raw), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == Counter(want)
    by_text = defaultdict(set)
    for r, t in ((r, t) for r in media_mpeg.to_mpeg(edge_docs.where("doc_id = 8")).collect() for t in ("x",)):
        by_text[t].add((bytes(r.media), r.feature))
    assert len(by_text["x"]) == 1
    assert media_mpeg.to_mpeg(no_docs).count() == 0

"""Each operator against its plain version, on a table of odd rows and on an empty one."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetide.llm import chat_windows, components, decontaminate, language_id, line_dedup, mixing, repetition, simhash_anchor, suffix_array, suffix_dedup, toxicity, url_filter

from . import plain


def bag(rows):
    return Counter(tuple(r) for r in rows)


# ---------------------------------------------------------------- suffix arrays
@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    n, length = int(rng.integers(1, 300)), int(rng.integers(2, 12))
    text = rng.integers(1, 2 + rng.integers(1, 5), n).astype(np.uint16)
    if n > 60:
        text[30:60] = text[:30]
    text = np.append(text, 0).astype(np.uint16)
    sa = suffix_array.suffix_array(text, length)
    assert sorted(sa) == list(range(n + 1))
    heads = [tuple(text[i : i + length]) for i in sa]
    assert heads == sorted(heads)
    seen = Counter(tuple(text[i : i + length]) for i in range(n + 2 - length))
    expected = [i + length <= n + 1 and seen[tuple(text[i : i + length])] > 1 for i in range(n + 1)]
    assert suffix_array.repeats(text, sa, length).tolist() == expected


def test_same_place_is_no_repeat():
    text = np.array([2, 3, 4, 1, 2, 3, 4, 1, 0], np.uint16)
    sa = suffix_array.suffix_array(text, 3)
    place = np.array([7, 8, 9, 1, 7, 8, 9, 2, 3], np.uint64)
    assert not suffix_array.repeats(text, sa, 3, place).any()


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 399, 799, 799, 5000])
    rows, h, at, first, last = suffix_dedup.anchors(data, offsets)
    starts = sorted((int(r), p) for r, a, b in zip(rows, first, last, strict=True) for p in range(a, b + 1))
    assert starts == [(r, p) for r in range(4) for p in range(int(offsets[r + 1] - offsets[r]) - 399)]
    assert ((first <= at) & (at + suffix_dedup.GRAM <= first + 400) & (last <= at)).all()


@pytest.mark.parametrize("group_bytes", [6 << 20, 300])
def test_suffix_dedup(odd, pairs, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    assert bag(suffix_dedup.suffix_dedup(odd).collect()) == bag(plain.suffix_dedup(pairs))


def test_suffix_dedup_of_slices(spark, monkeypatch):
    """A text longer than a slice, repeated inside itself and across the cut."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, body + body[4000:5200] + body[:100]), (2, body[4700:5300]), (3, body[:350])]
    covered = Counter()
    for lo, at, data, offsets in suffix_dedup.long_rows(pa.array([t for _, t in rows])):
        r, _, _, first, last = suffix_dedup.anchors(data, offsets)
        covered.update((int(x) + lo, p + at) for x, a, b in zip(r, first, last, strict=True) for p in range(a, b + 1))
    assert max(covered.values()) == 1 and len(covered) == sum(max(0, len(t) - 399) for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert bag(suffix_dedup.suffix_dedup(df).collect()) == bag(plain.suffix_dedup(rows))


def test_copies_from_many_tasks_do_not_make_a_group_heavy(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 3000)
    rows = [(1, 7, 8, bytearray(1000))] * 400 + [(2, k, k, bytearray(1000)) for k in range(4)] + [(3, 5, 5, bytearray(3001))]
    given = spark.createDataFrame(rows, "g long, u1 long, u2 long, bytes binary")
    assert sorted(r["_g"] for r in suffix_dedup.heavy_groups(given).collect()) == [2, 3]


# ---------------------------------------------------------------- decontamination
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "SHORT"), (3, None), (4, "another Text"), (None, "several documents share"), (2, "zz")]


@pytest.mark.parametrize("block_bytes", [8 << 20, 20])
def test_decontamination(spark, odd, pairs, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = plain.decontaminate(pairs, [("null" if i is None else i, t) for i, t in ITEMS])
    assert bag(decontaminate.find_windows(odd, bench).collect()) == bag(expected)
    stays = Counter(r["doc_id"] for r in decontaminate.clean(odd, bench).collect())
    assert stays == Counter(e[0] for e in expected if not e[5])


def test_repeated_items_do_not_fill_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    texts = [(1, "one row of the benchmark, many times over")] * 50 + [(k, f"row {k} of the benchmark") for k in range(2, 40)]
    items, n = decontaminate.item_blocks(spark.createDataFrame(texts, "item_id long, text string"))
    assert items.count() == 39 and n == -(-sum(len(t) for _, t in set(texts)) // 200)
    assert items.groupBy("_block").agg(F.sum(F.length("text"))).agg(F.max("sum(length(text))")).first()[0] <= 3 * 200


def test_clean_keeps_columns_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert bag(decontaminate.clean(odd, bench).collect()) == bag(odd.collect())
    assert decontaminate.find_windows(empty, bench).collect() == []


def test_shift_tables_miss_nothing(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(6)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 10, 11, 14])))) for k in range(12)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 60, 1500])))) for k in range(20)]
    rows += [(99, rows[-1][1] + " " + items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert bag(decontaminate.find_windows(docs, bench).collect()) == bag(plain.decontaminate(rows, items))


# ---------------------------------------------------------------- mixing
def test_mixing(odd, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    _, total, target = plain.mixture(rows)
    got = mixing.mix(odd).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, words in target.items():
        assert abs(taken[source] - words) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))


def test_mixing_order_and_budget(odd, empty):
    finish = [r["finish"] for r in mixing.mix(odd).collect()]
    assert [f for f in finish if f is not None] == sorted(f for f in finish if f is not None)
    half = mixing.mix(odd, 0.5).agg(F.sum("taken")).first()[0]
    whole = odd.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(half - whole / 2) <= 6
    assert mixing.mix(empty).collect() == []


# ---------------------------------------------------------------- repetition
def test_repetition(odd, pairs, empty):
    got = {}
    for r in repetition.repetition_rules(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in pairs:
        base, failed, share, line = plain.repetition(text if text is None or len(text) < 20_000 else text[:0])
        if text is not None and len(text) >= 20_000:
            continue
        match = [r for r in got[i] if tuple(r[c] for c in repetition.COUNTS) == base]
        assert match, (i, base)
        r = match[0]
        assert r["base_failed"] == failed and r["line_coverage"] == pytest.approx(line)
        assert all(r[f"coverage_{n}"] == pytest.approx(share[n]) for n in share)
        runs = plain.repeat_runs(text)
        limits = repetition.MANY_COVERAGE if runs >= repetition.MANY_RUNS else repetition.MAX_COVERAGE
        good = not failed and line <= 0.2 and all(share[n] <= most for n, most in limits.items())
        assert r["n_repeat_runs"] == runs
        assert r["kept"] == good
    assert repetition.repetition_rules(empty).collect() == []


def test_several_repeated_passages_have_lower_limits(spark):
    own = lambda tag, n: " ".join(f"{tag}{k:02d}" for k in range(n))
    twice = f"{own('p', 12)} {own('a', 60)} {own('p', 12)} {own('b', 60)}"
    two = f"{own('p', 6)} {own('a', 50)} {own('q', 6)} {own('b', 50)} {own('p', 6)} {own('c', 10)} {own('q', 6)} {own('d', 10)}"
    thrice = f"{own('p', 8)} {own('a', 55)} {own('p', 8)} {own('b', 55)} {own('p', 8)} x"
    rows = [(0, twice), (1, two), (2, thrice), (3, own("a", 100))]
    got = {r["doc_id"]: r for r in repetition.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [got[k]["kept"] for k in range(4)] == [True, False, False, True]
    assert [got[k]["n_repeat_runs"] for k in range(4)] == [2, 4, 3, 0]


# ---------------------------------------------------------------- lines
def test_line_dedup(odd, pairs, empty):
    assert bag(line_dedup.line_dedup(odd).drop("keep").collect()) == bag(plain.line_dedup(pairs))
    kept = line_dedup.drop_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert bag((r["doc_id"], plain.sha(r["text"] or "")) for r in kept.collect()) == bag((r[0], r[3]) for r in plain.line_dedup(pairs))
    assert kept.where("n_chars <> length(text)").isEmpty()
    assert line_dedup.drop_lines(empty).collect() == []


def test_hot_line_over_many_ranges(spark):
    """A key that spans several ranges, among others, at any number of partitions."""
    hot = "the very same line in nearly every document"
    rows = [(k, f"{hot}\n{hot}\nonly here {k} and nowhere else at all\nshared by few documents {k % 60}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert bag(line_dedup.line_dedup(df).drop("keep").collect()) == bag(plain.line_dedup(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


# ---------------------------------------------------------------- urls
URLS = [None, "", "no scheme/es/", "http://example.org", "http://example.org?x=/es/", "HTTP://A.Example.ORG/es/1", "http://example.org/en/17", "http://example.org/en/2",
        "http://x.com/fr/", "http://x.com/fr", "http://com/de/1#a", "https://notexample.org/es/", "ftp://example.org:80/es/", "http://a://b.com/de/", "http://example.com/\n/de/"]


def plain_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:cut].translate(plain.LOWER)
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h), len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {k: plain_url(u, rules) for k, u in enumerate(URLS)}
    table = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    joined = {r["page_id"]: tuple(r)[1:] for r in url_filter.join_rules(df, table).collect()}
    assert joined == got
    assert url_filter.filter_urls(df.limit(0), rules).collect() == []


# ---------------------------------------------------------------- language
def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 30):
        code = language_id.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= {2: 1, 3: 2, 4: 4, 5: 8}.get(n, 3)


def test_language(spark, odd, empty):
    words = {"en": "the and of that with", "fr": "les des une dans pour", "de": "der und nicht mit ein", "es": "los una para como por"}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(words[la].split(), k=12)), la) for k in range(400) for la in [list(words)[k % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    got = language_id.identify(df, model).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("held_out AND lang_pred <> lang").count() == 0 and got.where("held_out").count() > 50
    assert got.where("score < 0 OR score > 1").isEmpty()
    odd_rows = language_id.identify(odd, model).collect()
    assert {r["doc_id"] for r in odd_rows if r["lang_pred"] == "und"} == {4, 5, 6, 11}
    assert all(r["rejected"] and r["score"] == 0 for r in odd_rows if r["lang_pred"] == "und")
    kept = language_id.known_language(odd, model)
    assert kept.columns == odd.columns and not {4, 5, 6, 11} & {r["doc_id"] for r in kept.collect()}
    assert {r["lang_pred"] for r in language_id.identify(empty).collect()} == set()
    one = language_id.identify(df.withColumn("lang", F.lit("xx"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in one] == ["xx"]
    none = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


# ---------------------------------------------------------------- near duplicates
def test_anchors_reach_every_link():
    """Any two values within the distance meet: one's home is among the other's replicas, in one of the halves."""
    rng = np.random.default_rng(0)
    patterns = [simhash_anchor._patterns(1 + t) for _, t in simhash_anchor.HALVES]
    for _ in range(400):
        a = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        met = False
        for k, (shift, _) in enumerate(simhash_anchor.HALVES):
            x, y = (np.array([v >> shift & 0xFFFFFFFF], np.uint64) for v in (a, b))
            home = simhash_anchor.homes(x)[0]
            assert int(home ^ x[0]).bit_count() <= 1
            met |= home in y[0] ^ patterns[k][simhash_anchor._syndromes(y)[0]]
        assert met


def test_near_duplicates(odd, pairs, empty):
    short = [(i, t) for i, t in pairs]
    assert bag(simhash_anchor.near_duplicates(odd).collect()) == bag(plain.near_duplicates(short))
    first = simhash_anchor.first_of_each(odd)
    expected = {c for _, _, c in plain.near_duplicates(short)}
    assert first.columns == odd.columns and Counter(r["doc_id"] for r in first.collect()) == Counter(expected)
    assert simhash_anchor.near_duplicates(empty).collect() == []


def test_chains_of_links(spark):
    """Fingerprints that differ in three bits from step to step form one component, however far its ends are apart."""
    chain = [sum(1 << (b % 64) for b in range(3 * k)) for k in range(20)]
    rows = [(v - 2**64 if v >= 2**63 else v,) for v in chain]
    links = simhash_anchor.links(spark.createDataFrame(rows, "fp long"))
    got = components.components(links, "a", "b").collect()
    assert len({r["u"] for r in got}) == len(set(rows)) and len({r["v"] for r in got}) == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1040)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# ---------------------------------------------------------------- toxicity
def test_toxicity(spark, odd, empty):
    rng = random.Random(6)
    calm = [f"{a}{b}{c}" for a in ("ta", "re", "mi") for b in ("no", "la") for c in ("s", "ra", "to")]
    rows, marks = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = rng.choices(calm, k=30) + ([rng.choice(["zurk", "zurkon", "vexbad"])] if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.count() > 80 and got.where("predicted <> toxic").count() <= 2
    assert got.where("predicted <> int(score >= 0.5) OR score < 0 OR score > 1").isEmpty()
    assert toxicity.score_toxicity(odd, labels.where("toxic = 1")).where("score <> 1").isEmpty()
    assert toxicity.score_toxicity(odd, labels.limit(0)).where("score <> 0").isEmpty()
    assert toxicity.score_toxicity(odd, labels).count() == odd.count()
    assert toxicity.score_toxicity(empty, labels).collect() == []


# ---------------------------------------------------------------- chat
def test_chat_windows(spark):
    rng = random.Random(8)
    tricky = ["", None, "<|end|>", "<~|", "<<|now|>~<", "</s>[INST] ok [/INST]", "a" * 5000, "ñ<|loss|>x"]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 2, 9, 40])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", None, "<|turn|>"])
            text = rng.choice(tricky) if rng.random() < 0.4 else "word " * rng.randrange(400)
            rows.append((conv, turn if rng.random() < 0.9 else None, role, text))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows.windows(df)
    formatted = windows.collect()
    budget = {(r["conv_id"], r["window"]): r["formatted"] for r in formatted}
    got = {r["conv_id"]: r for r in chat_windows.read_back(windows).collect()}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv, turns in convs.items():
        turns = sorted(turns, key=lambda r: (low(r[1]), r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), plain.sha(whole), len(loss), plain.sha(loss))
        assert r["formatted_chars"] == sum(len(t) for (c, _), t in budget.items() if c == conv)
        if any(t[2] == "system" for t in turns[:1]):
            assert all("<|turn|>system" in t for (c, _), t in budget.items() if c == conv)
    # Windows of several new turns stay within the budget.
    for text in budget.values():
        past, new = text.split(chat_windows.NOW)
        turns = [t for t in (past + new).split(chat_windows.END) if t]
        if new.count(chat_windows.TURN) > 1:
            spare = chat_windows.BUDGET // 4 + sum(1 + len(t) / 4 for t in turns if "<|turn|>system" in t)
            assert sum(1 + (len(t) - 16) / 4 for t in turns) <= chat_windows.BUDGET + spare + 3 * len(turns)
    assert chat_windows.read_back(chat_windows.windows(df.limit(0))).collect() == []


def test_long_conversation_stays_in_rows_of_one_window(spark):
    """Turns meet by window, never by conversation, and a conversation of many windows reads back whole."""
    turns = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("text "), (F.col("id") % 300).cast("int")).alias("text"))
    windows = chat_windows.windows(turns)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line.split("[", 1)[1].split("]", 1)[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert grouped and all("window#" in keys for keys in grouped)
    assert windows.count() > 300 and windows.agg(F.max(F.length("formatted"))).first()[0] < 2 * chat_windows.CHARS_PER_TOKEN * chat_windows.BUDGET
    whole = "".join(f"{'user' if k % 2 == 0 else 'assistant'}\n{'text ' * (k % 300)}\n" for k in range(3000))
    row = chat_windows.read_back(windows).first()
    assert row["n_turns"] == 3000 and row["turns_sha256"] == plain.sha(whole)

"""Operators over the whole corpus, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapewatch.llm import catalogue, decontaminate, line_dedup, mixing, near_copies, quality_rules, simhash
from tapewatch.llm import components as components_module
from tapewatch.llm.components import connected
from tests.compare import differences, duck
from tests.llm.conftest import FOLDER

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    low = list(range(n))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def near(prints, bits):
    values = np.array(prints, np.int64).view(np.uint64)
    return [(i, j) for i in range(len(values)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits))]


def plain_fingerprint(text, size):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_sql_counterparts(spark):
    con = duck(FOLDER)
    for name, sql in catalogue.SQL.items():
        assert differences(catalogue.QUERIES[name](spark, FOLDER), con, sql) is None, name


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(0, k) for k in range(300, 400)] + [(k, k + 1) for k in range(400, 440)]
    expected = components(441, links)
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert [found.get(k, k) for k in range(441)] == expected
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_made_in_tasks(spark, monkeypatch):
    """Edges of one task need no further round; those of many tasks, and of tasks that hold few edges at a time, give the same."""
    draw = random.Random(4)
    links = [(k + 1, k) for k in range(300)] + [(400, k) for k in range(401, 500)] + [(draw.randrange(500, 900), draw.randrange(500, 900)) for _ in range(300)] + [(-5, -5), (-7, -6)]
    low = components(908, [(a + 7, b + 7) for a, b in links])
    expected = {k - 7: low[k] - 7 for k in range(908) if low[k] != k}
    frame, rounds, staged = spark.createDataFrame(links, "a long, b long"), [], components_module.staged
    monkeypatch.setattr(components_module, "staged", lambda df: rounds.append(df) or staged(df))
    assert {r["node"]: r["root"] for r in connected(frame.coalesce(1)).collect()} == expected
    assert len(rounds) == 1
    monkeypatch.setattr(components_module, "HELD_EDGES", 20)
    assert {r["node"]: r["root"] for r in connected(frame.repartition(5)).collect()} == expected


def test_few_components_of_many_tasks_need_no_rounds(spark, monkeypatch):
    """Edges that lie in many tasks, fewer than one holds, are put together at once: a chain through all tasks takes two lineage cuts."""
    draw = random.Random(5)
    links = [(k + 1, k) for k in range(300)] + [(draw.randrange(400, 700), draw.randrange(400, 700)) for _ in range(250)]
    low = components(700, links)
    cuts, staged = [], components_module.staged
    monkeypatch.setattr(components_module, "staged", lambda df: cuts.append(df) or staged(df))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert found == {k: low[k] for k in range(700) if low[k] != k}
    assert len(cuts) == 2


def test_links_for_every_limit(spark):
    draw = np.random.default_rng(5)
    for bits in (1, 2, 3):
        rows = []
        for base in draw.integers(-(2**63), 2**63 - 1, 25):
            now = int(base)
            for _ in range(draw.integers(1, 12)):
                value = now
                for bit in draw.integers(0, 64, draw.integers(0, 4)):
                    value ^= 1 << int(bit)
                value = (value + 2**63) % 2**64 - 2**63
                rows.append(value)
                now = value if draw.random() < 0.3 else now
        prints = spark.createDataFrame(list(enumerate(rows)), "k long, fingerprint long")
        found = {r["k"]: r["component_id"] for r in simhash.near_duplicates(prints, "k", bits).collect()}
        assert [found[k] for k in range(len(rows))] == components(len(rows), near(rows, bits))


def test_carried_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINKED_ROWS", 5)
    rows = [(k, (1 << k) | (1 << (k + 1))) for k in range(20)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "k long, fingerprint long"), "k", 2)
    assert {r["component_id"] for r in found.collect()} == {0}


def test_op6(spark, texts):
    keys = sorted(texts)
    prints = [plain_fingerprint(texts[k], 3) for k in keys]
    low = components(len(keys), near([p - 2**64 if p >= 2**63 else p for p in prints], 2))
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalogue.QUERIES["op6_simhash"](spark, FOLDER).collect()}
    assert rows == {k: (f"{p:016x}", keys[c]) for k, p, c in zip(keys, prints, low)}


def plain_lines(rows):
    """Removed lines of (key, text) rows in order."""
    sets, seen, found = [], set(), {}
    for key, text in rows:
        removed, n = [], 0
        for place, line in enumerate(text.split("\n")):
            words = frozenset(WORDS.findall(line.lower()))
            if words:
                n += 1
                if words in seen or any(10 * len(words & s) >= 8 * len(words | s) for s in sets):
                    removed.append(place)
                if words not in seen:
                    seen.add(words)
                    sets.append(words)
        found[key] = (n, ",".join(map(str, removed)))
    return found


def test_op3(spark, texts):
    rows = {r["doc_id"]: (r["n_lines"], r["removed_lines"]) for r in catalogue.QUERIES["op3_line_dedup"](spark, FOLDER).collect()}
    assert rows == plain_lines(sorted(texts.items()))


@pytest.mark.parametrize("large", [2, line_dedup.LARGE])
def test_near_lines_in_large_groups(spark, monkeypatch, large):
    """Groups whose members are near some, not all, of the others; both ways give the same rows."""
    monkeypatch.setattr(line_dedup, "LARGE", large)
    draw = random.Random(8)
    base = [[f"w{g}_{k}" for k in range(20)] for g in range(4)]
    lines = []
    for _ in range(160):
        words = list(draw.choice(base))
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(20)] = f"x{draw.randrange(60)}"
        lines.append(" ".join(words[: draw.randint(14, 20)]))
    docs = [(k, "\n".join(lines[4 * k : 4 * k + 4])) for k in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r["key"]: (r["n_lines"], ",".join(map(str, r["removed"]))) for r in line_dedup.summary(line_dedup.repeated_lines(frame)).collect()}
    expected = plain_lines(docs)
    assert found == expected
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(frame).collect()}
    for key, text in docs:
        gone = set(filter(None, expected[key][1].split(",")))
        assert kept[key] == "\n".join(x for k, x in enumerate(text.split("\n")) if str(k) not in gone)


ITEM = "A train leaves Boston at 5 km per hour and reaches Denver after 12 hours of slow travel today."


def test_reparameterised_questions(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "short item ends here now"), (3, None), (4, ""), (5, "too few")], "item_id long, text string")
    rows = [
        (1, "Before. A train leaves Paris at 7 miles per hour and reaches Lyon after 30 days of slow travel today. After", (1, False)),
        (2, "A train leaves Paris at 7 km per hour and reaches Paris after 9 hours of slow travel today.", None),
        (3, None, None),
        (4, "nothing to see", None),
        (5, "say short item ends here now yes", (2, True)),
        (6, ITEM.upper(), (1, True)),
        (7, "x " * 30000 + ITEM, (1, True)),
        (8, "too few", None),
        (None, ITEM, (1, True)),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.find_leaks(docs, items).collect()}
    expected = {(key, hit[0]): hit[1] for key, _, hit in rows if hit and key != 6}
    assert {k: v for k, v in found.items() if k[0] != 6} == expected
    assert decontaminate.find_leaks(docs, items.where("false")).count() == 0 and decontaminate.find_leaks(docs.where("false"), items).count() == 0


def test_leaks_at_every_place(spark):
    """Windows are looked up in steps that no leak falls between, wherever it begins; a short item shortens the steps."""
    item = "kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu"
    few = " ".join(item.split()[::-1][:9])
    rows = [(100 * run + lead, " ".join(["x"] * lead + item.split()[2 : 2 + run] + ["y"] * 5)) for run in (12, 13) for lead in range(14)]
    docs = spark.createDataFrame(rows + [(lead, "x " * lead + few + " y") for lead in range(14)], "doc_id long, text string")
    for items, step in (([(1, item)], 6), ([(1, item), (2, few)], 1)):
        frame = spark.createDataFrame(items, "item_id long, text string")
        windows = decontaminate.benchmark_windows(frame, "item_id", "text")
        assert [(r["size"], r["step"]) for r in decontaminate.sizes_of(windows, decontaminate.RUN)] == [(decontaminate.WINDOW, step)]
        found = {(r["doc_id"], r["item_id"], r["n_words"], r["exact"]) for r in decontaminate.find_leaks(docs, frame).collect()}
        assert found == {(1300 + lead, 1, 13, True) for lead in range(14)} | {(lead, 2, 9, True) for lead in range(14) if step == 1}


def plain_leaks(docs, items):
    """Every diagonal of every document and item, word by word; all stretches of a match tried."""
    size_, run, shortest, marks = decontaminate.WINDOW, decontaminate.RUN, decontaminate.SHORTEST, {decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT}
    found = {}
    for key, words, spoken in docs:
        for item, theirs, said in items:
            size = min(size_, len(theirs))
            if size < shortest:
                continue
            for diagonal in range(size - len(theirs), len(words) - size + 1):
                same = lambda at: 0 <= at - diagonal < len(theirs) and words[at] == theirs[at - diagonal]  # noqa: E731, B023
                fits = lambda at: all(same(k) for k in range(at, at + size)) and 2 * sum(words[k] in marks for k in range(at, at + size)) <= size  # noqa: E731, B023
                starts = [at for at in range(max(0, diagonal), len(words) - size + 1) if fits(at)]
                for begin in [at for at in starts if at - 1 not in starts]:
                    end = next(at for at in range(begin, len(words) + 1) if at not in starts) + size - 1
                    slots = [(k, spoken[k], said[k - diagonal]) for k in range(begin, end) if words[k] in marks]
                    at_odds = [(p[0], q[0]) for p in slots for q in slots if p[0] < q[0] and (p[1] == q[1]) != (p[2] == q[2])]
                    a, b = max(((a, b) for a in range(begin, end) for b in range(a + 1, end + 1) if not any(a <= p and q < b for p, q in at_odds)), key=lambda s: (s[1] - s[0], -s[0]))
                    differ = sum(a <= k < b and mine != other for k, mine, other in slots)
                    if b - a - (differ if at_odds else 0) >= min(run, max(len(theirs) - 1, shortest)):
                        n, exact = found.get((key, item), (0, False))
                        found[key, item] = (max(n, b - a), exact or differ == 0)
    return found


def test_leaks_are_what_all_diagonals_give(spark):
    """Items full of names and numbers, copied whole, in part, with values exchanged one to one and at random."""
    draw = random.Random(12)
    names, plain = ["Tom", "Bob", "Ann", "Eve", "Kim"], "goes sees with then over under after many small red home again".split()

    def word(k):
        return draw.choice(plain) if k % 3 else draw.choice([draw.choice(names), str(draw.randrange(4)), f"{draw.randrange(4)} km"])

    items = [(k, "so " + " ".join(word(j) for j in range(draw.choice([4, 6, 9, 20, 45])))) for k in range(14)]
    items += [(3, "so " + " ".join(word(j) for j in range(30))), (None, "so " + " ".join(word(j) for j in range(20)))]
    docs = []
    for k in range(150):
        words = draw.choice(items)[1].split()
        turned = dict(zip(names, draw.sample(names, 5), strict=True)) if k % 3 else {}
        words = [turned.get(w, w) for w in words]
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            at = draw.randrange(len(words))
            words[at] = draw.choice(names) if words[at] in names else str(draw.randrange(4)) if words[at].isdigit() else words[at]
        docs.append((k, "and " + " ".join(words) + " and"))
    tom = "so " + " ".join("Tom" if j in (6, 18, 30) else plain[j % 11] + "abcdefghijklmnopqrstuvwxyz"[j % 26] for j in range(36))
    items.append((90, tom))
    docs.append((900, tom[: tom.rindex("Tom")] + "Bob" + tom[tom.rindex("Tom") + 3 :]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    split = lambda df, key: [tuple(r) for r in df.select(key, decontaminate.template(F.col("text")), decontaminate.values(F.col("text"))).collect()]
    expected = plain_leaks(split(frame, "doc_id"), split(table, "item_id"))
    found = {(r["doc_id"], r["item_id"]): (r["n_words"], r["exact"]) for r in decontaminate.find_leaks(frame, table).collect()}
    assert found == expected and (900, 90) in found and 50 < len(found) and len({n for n, _ in found.values()}) > 5


def test_op5_finds_passages(spark, texts):
    """Documents that share thirteen words in a row with an item, and no others."""
    size = decontaminate.RUN
    windows = lambda t: {tuple(w[k : k + size]) for w in [re.findall(r"\w+", t.lower())] for k in range(len(w) - size + 1)}
    items = {r["item_id"]: windows(r["text"] or "") for r in catalogue.benchmark(spark, FOLDER).collect()}
    expected = {(d, i) for d, text in texts.items() for own in [windows(text)] for i, w in items.items() if own & w}
    rows = catalogue.QUERIES["op5_decontaminate"](spark, FOLDER).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected and expected


def test_policies_and_ablations(spark, docs):
    ledger = quality_rules.rule_ledger(docs).cache()
    total = ledger.count()
    rows = {(r["policy"], r["rule"]): r for r in quality_rules.ablations(ledger).collect()}
    for policy, rules in quality_rules.POLICIES.items():
        kept = quality_rules.apply_policy(ledger, policy).count()
        for rule in rules:
            mask = quality_rules.mask_of(policy) & ~(1 << quality_rules.RULE_BITS[rule])
            without = ledger.where(F.col("ledger.bits").bitwiseAND(F.lit(mask)) == 0).count()
            assert rows[policy, rule]["n_docs"] == total and without - kept == rows[policy, rule]["n_only_this_rule"]
    ledger.unpersist()


def test_repeated_window_words(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choices("abc", k=draw.randint(0, 14))) for _ in range(150)]
    rows = quality_rules.rule_ledger(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        words = r["text"].split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts = Counter(windows)
        expected = len({k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)})
        assert r["ledger"]["measured"]["n_repeat_words"] == expected, r["text"]


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, l, "t", float(10 + 7 * i)) for i, (s, l) in enumerate([(s, l) for s in "abc" for l in "xy"])], "source string, lang string, topic string, n_tokens double")
    share = lambda d, values: spark.createDataFrame(list(values.items()), f"{d} string, share double")
    wanted = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"t": 1.0}}
    raked = mixing.rake(cells, {d: share(d, v) for d, v in wanted.items()}, 12).collect()
    total = sum(r["n_tokens"] * r["factor"] for r in raked)
    for d, values in wanted.items():
        for value, target in values.items():
            assert abs(sum(r["n_tokens"] * r["factor"] for r in raked if r[d] == value) / total - target) < 1e-6


def test_one_scarce_cell_does_not_thin_the_corpus(spark):
    sources = ["hot"] + [f"s{k}" for k in range(20)]
    cells = [(s, f"l{l}", f"t{t}", 1e6 * (20 if s == "hot" else 1) * (4 - l)) for s in sources for l in range(4) for t in range(3)]
    schema = "source string, lang string, topic string, n_tokens double"
    shares = []
    for more in ([], [("typo", "l0", "t0", 60.0)]):
        frame = spark.createDataFrame(cells + more, schema)
        targets = {d: mixing.tempered(frame, d, power) for d, power in mixing.POWERS.items()}
        found, error = mixing.fitted(frame, targets)
        rows = found.collect()
        shares.append(sum(r["n_tokens"] * r["probability"] for r in rows) / sum(r["n_tokens"] for r in rows))
        assert error <= mixing.TOLERANCE and len(rows) == len(cells + more)
        assert all(r["probability"] == 1 for r in rows if r["source"] == "typo")
    assert abs(shares[0] - shares[1]) < 0.01 and shares[0] > 0.4
    old = mixing.probabilities(mixing.rake(frame, targets)).collect()
    assert sum(r["n_tokens"] * r["probability"] for r in old) / sum(r["n_tokens"] for r in old) < 0.1
    kept = mixing.mixed(frame.withColumn("doc_id", F.lit(1)), scarce=mixing.SCARCE)
    assert kept.count() == len(cells) + 1 and mixing.mixed(frame.withColumn("doc_id", F.lit(1)).where("false"), scarce=mixing.SCARCE).count() == 0


def test_odd_rows(odd, empty, odd_rows):
    n = len(odd_rows)
    assert quality_rules.rule_ledger(odd).count() == n and quality_rules.rule_ledger(empty).count() == 0
    prints = simhash.fingerprints(odd).select("doc_id", "fingerprint")
    zero = [r["component_id"] for r in simhash.near_duplicates(prints, "doc_id").collect() if r["fingerprint"] == 0]
    assert zero == [3] * 4
    assert simhash.near_duplicates(simhash.fingerprints(empty).select("doc_id", "fingerprint"), "doc_id").count() == 0
    lines = {(r["key"], r["n_lines"]): r["removed"] for r in line_dedup.summary(line_dedup.repeated_lines(odd)).collect()}
    assert lines[2, 1] == [0] and line_dedup.repeated_lines(empty).count() == 0
    mixed = mixing.mixed(mixing.described(odd)).collect()
    assert len(mixed) == n and all(0 <= r["probability"] <= 1 for r in mixed)
    assert mixing.mixed(mixing.described(empty)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    """Each stage does what its operator decides, judged on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, FOLDER)
    verdicts = {r["doc_id"]: r["kept"] for r in catalogue.QUERIES["op10_quality_rules"](spark, FOLDER).collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {k for k, kept in verdicts.items() if kept}
    single = stages["simhash"](spark, good, FOLDER)
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    low = components(len(rows), near_sets(shingle_sets([t or "" for _, t in rows])))
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {rows[c][0] for c in low}
    clean = stages["decontaminate"](spark, single, FOLDER)
    leaking = {r["doc_id"] for r in decontaminate.find_leaks(single, catalogue.benchmark(spark, FOLDER)).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaking
    drawn = stages["mixing"](spark, clean, FOLDER)
    kept = {r["doc_id"] for r in drawn.collect()}
    assert drawn.columns == docs.columns and kept and kept <= {r["doc_id"] for r in clean.collect()}
    last = corpus_pipeline.run(spark, FOLDER)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {r["doc_id"] for r in last.collect()} == kept


def test_one_of_each_group_of_copies(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.keep_one_of_copies(spark, docs, FOLDER).collect()
    texts = Counter((r["text"] or "").strip(" \t\n\x0b\x0c\r") for r in kept)
    assert set(texts.values()) == {1} and corpus_pipeline.keep_one_of_copies(spark, empty.select(docs.columns), FOLDER).count() == 0


def shingle_sets(texts):
    words = [WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_line_tokens_are_counted_in_all_texts(spark):
    """Every word counts, wherever it stands, so that the byte of a class tells words that stand once from all others."""
    texts = [f"Own{k} both\tBOTH\n\nboth" for k in range(40)] + [None, " \n "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = spark.createDataFrame([(w,) for w in ["both", *[f"own{k}" for k in range(40)]]], "word string")
    ranks = line_dedup.rarity_table(docs, "text")
    found = words.withColumn("ranks", ranks).select("word", F.col("ranks")[line_dedup.cell(F.xxhash64("word"))].alias("rank"))
    expected = {"both": int(4 * math.log2(1 + 120))} | {f"own{k}": line_dedup.ONCE for k in range(40)}
    assert {r["word"]: r["rank"] for r in found.collect()} == expected


def test_lines_are_dealt_once_for_the_summary(spark):
    """A document's lines meet in one shuffle; copies of a document count its lines once."""
    rows = [(1, 5, 0, False), (1, 5, 2, True), (1, 5, 0, False), (1, 5, 2, True), (2, 6, 1, False), (None, 7, 0, True)]
    frame = spark.createDataFrame(rows, "key long, digest long, line int, removed boolean").repartition(3)
    found = line_dedup.summary(frame)
    assert found.schema["n_lines"].dataType.simpleString() == "bigint"
    assert {(r["key"], r["digest"], r["n_lines"], tuple(r["removed"])) for r in found.collect()} == {(1, 5, 2, (2,)), (2, 6, 1, ()), (None, 7, 1, (0,))}
    plan = line_dedup.summary(spark.createDataFrame(rows, frame.schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_signatures_hold_every_token(spark):
    """Sets may come twice; no set is computed again to see whether it is empty."""
    draw = random.Random(3)
    sets = [(k, [draw.randrange(-(2**63), 2**63) for _ in range(n)]) for k, n in enumerate((1, 4, 60, 300))]
    frame = spark.createDataFrame([*sets, sets[2]], "id long, tokens array<long>")
    expected = {}
    for k, tokens in sets:
        wide = [0] * line_dedup.WIDE
        for h in tokens:
            wide[(h >> 6) % line_dedup.WIDE] |= 1 << (h & 63)
        expected[k] = (len(tokens), [w - 2**64 if w >= 2**63 else w for w in wide])
    found = line_dedup.wide_signatures(frame)
    assert {r["id"]: (r["size"], [r[f"wide{k}"] for k in range(line_dedup.WIDE)]) for r in found.collect()} == expected
    computed = frame.select("id", F.array_distinct("tokens").alias("tokens"))
    assert "Filter" not in line_dedup.wide_signatures(computed)._jdf.queryExecution().optimizedPlan().toString()


def near_sets(sets):
    return [(j, i) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]


def test_near_copies_are_found_exactly(spark, monkeypatch):
    """Planted copies with edited words, chains of them, a common passage, and short texts."""
    monkeypatch.setattr(near_copies, "FILINGS", 300)
    monkeypatch.setattr(near_copies, "HELD_BYTES", 2000)
    draw = random.Random(11)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for _ in range(12):
        base = fresh(draw.randint(60, 200))
        texts.append(base)
        for _ in range(6):
            edited = list(draw.choice([base, texts[-1]]))
            for _ in range(draw.randint(0, len(edited) // 30)):
                edited[draw.randrange(len(edited))] = f"x{draw.randrange(10**6)}"
            texts.append(edited)
    texts += [passage + fresh(draw.randint(0, 30)) for _ in range(30)] + [fresh(4) for _ in range(3)] + [["a", "b"], ["A", "b"], [], []]
    texts = [" ".join(t) for t in texts]
    links = near_sets(shingle_sets(texts))
    expected = components(len(texts), links)
    prints = np.array([simhash.fingerprint(t, 5) for t in texts], np.int64).view(np.uint64)
    assert sum(int(np.bitwise_count(prints[i] ^ prints[j])) > corpus_pipeline.COPY_BITS for i, j in links) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = {r["doc_id"]: r["root"] for r in near_copies.near_copies(corpus_pipeline.with_digest(docs)).collect()}
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(roots[k], []).append(k)
    assert [groups[roots[k]][0] for k in range(len(texts))] == expected
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'a' AS source", "1L AS n_chars", "'clash' AS _digest", "'clash' AS root", "'clash' AS fingerprint")
    kept = corpus_pipeline.keep_one_of_copies(spark, full, FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))
    assert kept.columns == full.columns and {r["_digest"] for r in kept.collect()} == {"clash"}


def test_shingles_are_counted_in_all_texts(spark):
    texts = [f"a b c d e own{k}" for k in range(300)] + [None]
    table = near_copies.rarity_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    counts = np.zeros(len(table), np.int64)
    for text in texts:
        np.add.at(counts, near_copies.cells(near_copies.shingle_set(text or "")), 1)
    assert counts.max() == 300 and np.array_equal(table, np.floor(4 * np.log2(1.0 + counts)))


def test_no_near_copies_come_out(spark, docs, empty):
    """No two documents that stay have a similarity of 0.8."""
    kept = [r["text"] or "" for r in corpus_pipeline.keep_one_of_copies(spark, docs, FOLDER).collect()]
    assert not near_sets(shingle_sets(kept))
    assert len(kept) == len(set(components(len(texts := [r["text"] or "" for r in docs.collect()]), near_sets(shingle_sets(texts)))))
    bare = empty.select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.keep_one_of_copies(spark, bare, FOLDER).count() == 0


def test_near_fingerprints_alone_remove_nothing(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "COPY_BITS", 1)
    flat = lambda docs: docs.withColumn("fingerprint", F.lit(7).cast("long"))
    monkeypatch.setattr(simhash, "fingerprints", flat)
    texts = ["one two three four five six"] * 2 + ["seven eight nine ten eleven twelve"] * 2
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_copies(spark, docs, FOLDER).collect()) == [0, 2]

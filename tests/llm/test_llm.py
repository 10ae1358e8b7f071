"""Training-data operators against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import leakage, mixing, quantiles, runs, stuffing
from kinweave.llm.queries import vocabulary


def brute_runs(rows, slack):
    out = []
    rows = sorted({r for r in rows if None not in r and all(x == x for x in r)}, key=lambda r: (r[0], r[2], r[3], r[4], r[1]))
    cur = None
    for e, v, a, b, i in rows:
        if cur and cur[0] == e and cur[1] == v and a <= cur[4] + slack:
            cur[2] += 1
            cur[4] = max(cur[4], b)
            cur[6] = i
        else:
            if cur:
                out.append(tuple(cur))
            cur = [e, v, 1, a, b, i, i]
    if cur:
        out.append(tuple(cur))
    return {r for r in out if r[2] > 1}


@pytest.mark.parametrize("seed,chunk", [(1, 10**6), (2, 5), (3, 2), (4, 1)])
def test_runs(spark, seed, chunk):
    rnd = random.Random(seed)
    rows, i = [], 0
    for e in range(6):
        for _ in range(40 if e == 1 else 6):
            a = float(rnd.randrange(60))
            rows.append((e, 7 if e == 1 else rnd.randrange(2), a, a + rnd.randrange(1, 9), i))
            i += 1
    rows += [(9, 1, float(k), float(k + 1), 1000 + k) for k in range(30)] + [(10, 1, 0.0, 90.0, 2000)] + [(10, 1, float(k * 5), float(k * 5 + 1), 2001 + k) for k in range(1, 19)]
    rows += rows[:5] + [(None, 1, 1.0, 2.0, 1), (1, None, 1.0, 2.0, 1), (1, 1, float("nan"), 2.0, 1), (1, 1, None, 2.0, 1)]
    df = spark.createDataFrame(rows, "child long, parent long, left double, right double, id long").withColumn("entity", F.lit("x")).withColumn("chunk", F.lit(1))
    got = runs.collapse_runs(df, "child", "parent", rows_per_chunk=chunk, block=None if seed < 3 else 2)
    assert {(r["entity"], r["value"], r["n_rows"], r["from"], r["to"], r["first_id"], r["last_id"]) for r in got.collect()} == brute_runs(rows, 3)
    assert got.where("span <> `to` - `from`").count() == 0


def test_runs_empty(spark):
    df = spark.createDataFrame([], "child long, parent long, left double, right double, id long")
    assert runs.collapse_runs(df, "child", "parent").count() == 0


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1, 2), 3e9, np.inf])
    k = quantiles.to_key(x)
    assert (np.diff(k) >= 0).all() and k[4] == k[5] and (quantiles.from_key(k) == x).all()


def test_percentiles(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.choice([rnd.gauss(0, 1e6), rnd.random(), -3.0, 1e-300]), rnd.randrange(4)) for g in (1, 1, 1, 2, None) for _ in range(60)]
    rows += [(3, None, 1), (3, float("nan"), 1), (4, float("inf"), 2), (4, 2.0, 2), (5, 7.25, 1)]
    df = spark.createDataFrame(rows, "g long, v double, batch long").withColumn("key", F.lit("clash")).withColumn("grp", F.lit(1))
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(v for k, v, _ in rows if k == g and v is not None and v == v)
        for q in qs if own else ():
            want[g, q] = own[max(1, int(np.ceil(q * len(own)))) - 1]
    assert {(r["grp"], r["q"]): r["value"] for r in quantiles.percentiles(df, "g", "v", qs).collect()} == want
    for r in quantiles.combined(quantiles.histograms(df, "g", "v", "batch"), qs).collect():
        exact = want[r["grp"], r["q"]]
        assert r["low"] <= exact <= r["high"]
        if np.isfinite(exact) and abs(exact) > 1e-290:
            assert abs(r["low"] - exact) <= abs(exact) * 2**-19
    assert quantiles.percentiles(df.limit(0), "g", "v").count() == 0


def test_words():
    same = [
        "The coil of Étienne's ﬁlter membrane", "THE COIL (12) of Étienne&#39;s fil​ter mem-\nbrane", "<b>The</b> coil<br>of &Eacute;tienne's filter mem­\nbrane",
        "the   coil, of (3a, 4) Etienne s filter; mem<i>bra</i>ne",
    ]
    assert len({tuple(leakage.words(t)) for t in same}) == 1
    assert leakage.words(None) == [] and leakage.words(" <> ") == []


def test_leaks(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    shared = " ".join(rnd.choice(vocab) for _ in range(18))
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(25)) + (" " + shared if i < 3 else "")) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        i = rnd.randrange(12)
        ws = items[i][1].split()
        k, a = rnd.choice([8, 12, 13, 14, 20]), rnd.randrange(5)
        docs.append((d, " ".join(rnd.choice([*vocab, "other"]) for _ in range(10)) + " x " + " ".join(ws[a : a + k]) + " y"))
    docs += [(100, shared), (101, ""), (102, None), (103, items[3][1] + " q " + items[4][1] + " q " + items[3][1]), (103, items[5][1])]
    grams = {}
    for i, t in items:
        ws = leakage.words(t)
        for p in range(len(ws) - 12):
            grams.setdefault(tuple(ws[p : p + 13]), set()).add(i)
    want = set()
    for d, t in docs:
        ws = leakage.words(t)
        for p in range(len(ws) - 12):
            if len(own := grams.get(tuple(ws[p : p + 13]), ())) == 1:
                want.add((d, next(iter(own))))
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    ii = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = leakage.leaks(dd, ii).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and want
    assert next(r for r in got if (r["doc_id"], r["item_id"]) == (103, 3))["n_words"] == 25
    assert sorted(leakage.leaks(dd, ii, block_chars=200, shard_words=60).collect()) == sorted(got)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(leakage.words(t))
    for r in got:  # the longest match that begins with words of that item alone, and where it begins
        it, best = leakage.words(dict(items)[r["item_id"]]), 0
        for ws in texts[r["doc_id"]]:
            for p in range(len(it) - 12):
                for q in range(len(ws) - 12):
                    k = 0
                    while p + k < len(it) and q + k < len(ws) and it[p + k] == ws[q + k]:
                        k += 1
                    if k >= 13 and grams[tuple(it[p : p + 13])] == {r["item_id"]}:
                        best = max(best, k)
        assert r["n_words"] == best
        assert any(ws[r["doc_word"] : r["doc_word"] + best] == it[r["item_word"] : r["item_word"] + best] for ws in texts[r["doc_id"]])
    clean = {r["doc_id"] for r in leakage.without_leaks(dd, ii).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert leakage.leaks(dd.limit(0), ii).count() == 0 and leakage.leaks(dd, ii.limit(0)).count() == 0


@pytest.mark.parametrize("longest", [1, 4, 64])
def test_suffix_array(longest):
    rnd = random.Random(longest)
    docs = [(d, np.array([rnd.randrange(1, 4) for _ in range(rnd.randrange(40))], dtype="int32")) for d in range(8)]
    shard = leakage.Shard(docs, {str(i): i for i in range(1, 4)}, longest)
    width = 1 << (len(shard.ranks) - 1)
    suffixes = [shard.text[i : i + width].tolist() for i in shard.array]
    assert sorted(shard.array.tolist()) == list(range(len(shard.text)))
    assert all(a <= b for a, b in zip(suffixes, suffixes[1:]))
    block = leakage.Block([(7, ["1", "2", "9", "1", "3", "3", "2"], [0])])
    for j, ranks in enumerate(shard.test_ranks(block)):
        for t, r in enumerate(ranks.tolist()):
            part = ["1", "2", "9", "1", "3", "3", "2"][t : t + (1 << j)]
            where = [i for i in range(len(shard.text)) if [str(x) for x in shard.text[i : i + (1 << j)]] == part and len(part) == 1 << j]
            assert (r > 0) == bool(where) and all(shard.ranks[j][i] == r for i in where)


def test_poisson():
    for cap, mean in ((1, 0.3), (3, 2.2), (4, 3.999), (2, 5.0), (2, 0.0)):
        t = mixing.thresholds(mean, cap)
        us = (np.arange(20000) + 0.5) / 20000
        copies = sum((us > x).astype(int) for x in t) if t else np.zeros(1)
        assert copies.max() <= cap and abs(copies.mean() - min(mean, cap)) < 1e-3


def test_poisson_of_large_means():
    for cap, mean in ((1000, 700.0), (5000, 3000.5), (1000, 999.9), (1000, 1000 * (1 - 1e-14))):
        t = np.array(mixing.thresholds(mean, cap))
        assert len(t) == cap and (np.diff(t) >= 0).all() and abs((1 - t).sum() - mean) < 1e-3  # the mean is the sum of the chances to exceed 0, 1, ...


def test_mix(spark):
    rows = [(i, s, "word " * (3 + i % 5)) for s, n in (("a", 900), ("B ", 300), ("c", 90), ("x", 50)) for i in range(n)] + [(1, None, "q"), (2, "a", None), (3, "a", "")]
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, source string, text string").withColumn("copy", F.lit("clash")).withColumn("n_docs", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, targets, vocabulary()).collect()
    again = mixing.mix(docs.orderBy(F.desc("doc_id")), targets, vocabulary()).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in out) == sorted((r["doc_id"], r["copy"]) for r in again)
    assert {r["source"] for r in out} == {"a", "b", "c"} and max(r["copy"] for r in out if r["source"] == "a") == 1 and max(r["copy"] for r in out) <= 3
    shares = {r["source"]: r for r in mixing.shares(docs, targets, vocabulary()).collect()}
    assert set(shares) == {"a", "b", "c", "x", "gone", None}
    for s, part in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(shares[s]["actual_share"] - part) < 0.05
        assert shares[s]["mixed_tokens"] == sum(r["n_tokens"] for r in out if r["source"] == s)
    assert shares["gone"]["actual_share"] == 0 and shares["x"]["mixed_docs"] == 0
    assert mixing.count_tokens("", b"") == 0 and mixing.mix(docs.limit(0), targets, vocabulary()).count() == 0 and mixing.mix(docs, targets.limit(0), vocabulary()).count() == 0


PROSE = "The housing (12) is made of steel and it has a wall thickness of 5 mm. When the coil reaches its end position, the valve opens. A gap is left between the pin and the slot for oil. "
STUFFED = {
    "words": "cheap pump buy pump online pump price pump offer pump best pump " * 9,
    "links": "\n".join(f"https://parts-{i}.example/pump/{i}" for i in range(30)),
    "anchors": " | ".join(f'<a href="//shop-{i}.example/p?id={i}">buy pump</a>' for i in range(30)),
    "codes": " ".join(f"X{i:02d}B 12/{i:02d}" for i in range(60)),
    "terms": "pump\nvalve\nhousing\nseal ring\nbearing\nantenna\nlens\nsensor\nslot\n" * 4,
    "tags": " ".join(f"#buypump{i}" for i in range(60)),
    "table": "\n".join(f"Pump | valve | {i}.50 EUR | SKU-{i}99 | offer" for i in range(20)),
    "wide": "ポンプ、弁、筐体、電極、軸受、歯車、回転子、入口、出口、磁石、" * 9,
    "spanish": "intercambiador de calor precio intercambiador de calor comprar intercambiador de calor barato " * 6,
}


def test_stuffing(spark):
    for name, t in STUFFED.items():
        assert stuffing.stuffed_share(t)[1] > 0.5, name
        assert stuffing.stuffed_share(t + "\n" + PROSE)[1] > 0.5, name
        assert stuffing.stuffed_share(PROSE * 12 + "\n" + t[:80])[1] < 0.5, name
    for t in (PROSE, PROSE * 20, "Coil with pin", "", None, "1. A pump comprising a coil and a slot.\n2. The pump of claim 1, wherein the coil is of glass.", "軸受は板に固定され、その厚さは9ミリメートルである。板が停止する。", "The the coil of of the is fastened to to the pin."):
        assert stuffing.stuffed_share(t)[1] <= 0.5, t
    pump = "buy the pump, get the best pump for the price of a pump and compare the pump with any pump in the pump shop, since a pump is a pump. "
    assert stuffing.stuffed_share(pump * 6)[1] > 0.5 and stuffing.stuffed_share("\n".join(["The housing is made of steel and has a wall."] * 60))[1] > 0.5
    df = spark.createDataFrame([(1, STUFFED["codes"]), (2, PROSE), (3, None), (4, ""), (1, STUFFED["codes"])], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    assert sorted(r[0] for r in stuffing.stuffed_documents(df).collect()) == [1, 1]
    assert stuffing.stuffing(df.limit(0)).count() == 0
    assert stuffing.stuffed_share(PROSE * 20000)[1] < 0.01


SENTENCES = {
    "nl": "De uitvinding heeft betrekking op een pomp met een behuizing en een spoel. De behuizing is vervaardigd van staal en heeft een wanddikte van vijf millimeter. Wanneer de spoel de eindstand bereikt, gaat de klep open en stroomt de olie naar buiten.",
    "zh": "本发明涉及一种泵，所述泵包括壳体和线圈。壳体由钢制成，其壁厚为五毫米。当线圈到达终点位置时，阀门打开，油从出口流出。该装置可以用于多种场合，并且具有较长的使用寿命。",
    "ko": "본 발명은 하우징과 코일을 포함하는 펌프에 관한 것이다. 하우징은 강철로 만들어지며 벽 두께는 오 밀리미터이다. 코일이 끝 위치에 도달하면 밸브가 열리고 오일이 밖으로 흐른다.",
    "ru": "Изобретение относится к насосу, который содержит корпус и катушку. Корпус изготовлен из стали и имеет толщину стенки пять миллиметров. Когда катушка достигает конечного положения, клапан открывается и масло вытекает наружу.",
    "it": "L'invenzione riguarda una pompa con un alloggiamento e una bobina. L'alloggiamento è realizzato in acciaio e ha uno spessore di cinque millimetri. Quando la bobina raggiunge la posizione finale, la valvola si apre e l'olio scorre verso l'esterno.",
    "pl": "Wynalazek dotyczy pompy z obudową i cewką. Obudowa jest wykonana ze stali i ma grubość ścianki pięć milimetrów. Gdy cewka osiąga położenie końcowe, zawór otwiera się i olej wypływa na zewnątrz.",
    "tr": "Buluş, bir gövde ve bir bobin içeren bir pompa ile ilgilidir. Gövde çelikten yapılmıştır ve beş milimetre et kalınlığına sahiptir. Bobin son konumuna ulaştığında vana açılır ve yağ dışarı akar.",
    "fi": "Keksintö koskee pumppua, jossa on kotelo ja käämi. Kotelo on valmistettu teräksestä ja sen seinämän paksuus on viisi millimetriä. Kun käämi saavuttaa pääteasennon, venttiili avautuu ja öljy virtaa ulos.",
}


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_sentences_of_other_languages(lang):
    """Listed or not, tagged or not, on one line or several."""
    t = SENTENCES[lang]
    for text in (t, t * 4, "\n".join([t] * 3)):
        for tag in (None, lang, "xx"):
            assert stuffing.stuffed_share(text, tag)[1] < 0.5


def test_calibration(spark):
    """Thresholds follow the segments of a language; a language with few words keeps the defaults."""
    rows = [(i, (PROSE * 6 if i % 4 else STUFFED["words"]), "EN-x") for i in range(400)] + [(1000, SENTENCES["it"], "it")]
    m = stuffing.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    t, d = stuffing.calibrate(m), stuffing.default_thresholds()
    en = stuffing.LANGUAGES.index("en")
    low, high = (int(stuffing.BINS * x) for x in stuffing.LIMITS["function"][1:])
    assert low <= t[en][0] <= high and t[stuffing.LANGUAGES.index("it")] == d[stuffing.LANGUAGES.index("it")]
    got = {r["doc_id"] for r in stuffing.stuffed_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i for i in range(400) if i % 4 == 0}
    assert stuffing._parting([5.0, 1.0, 0.0, 0.0, 0.0, 1.0, 7.0]) in range(2, 6)

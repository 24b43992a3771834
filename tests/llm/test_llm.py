"""Distinct counts, packing, mixing and sentence units: defined results on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import distinct, mixing, packing, sentences


# distinct counts
def test_estimates_merge_without_loss(spark):
    df = spark.range(60_000).select(F.concat(F.lit(" Host-"), (F.col("id") % 20_000).cast("string")).alias("h"), (F.col("id") % 7).alias("g"), F.lit(1).alias("register"))
    df = df.unionByName(df.select(F.upper("h").alias("h"), "g", "register").limit(5_000)).unionByName(spark.createDataFrame([(None, 1, 1), ("  ", 2, 1)], "h string, g bigint, register int"))
    found = distinct.cells(df, ["g"], F.col("h"))
    whole = distinct.estimates(found, ["g"], [["g"], []])
    exact = {r.g: r.n for r in df.filter("trim(h) <> ''").groupBy("g").agg(F.countDistinct(F.lower(F.trim("h"))).alias("n")).collect()}
    got = {(r.grouping, r.g): r.estimate for r in whole.collect()}
    assert all(abs(got[1, g] - n) <= 5 * distinct.ERROR * n for g, n in exact.items()) and abs(got[0, None] - 20_000) <= 5 * distinct.ERROR * 20_000
    stored = distinct.sketches(found, ["g"])
    again = distinct.estimates(distinct.merged_cells(stored.withColumn("all", F.lit(1)), ["all"]), ["all"], [["all"]]).first()
    assert again.estimate == pytest.approx(got[0, None])
    sizes = stored.select(F.length("sketch").alias("n")).collect()
    assert all(r.n <= 1 << distinct.P for r in sizes) and distinct.sketches(distinct.cells(df.limit(40), ["g"], F.col("h")), ["g"]).agg(F.max(F.length("sketch"))).first()[0] <= 120
    assert distinct.estimates(distinct.cells(df.limit(0), ["g"], F.col("h")), ["g"], [["g"]]).count() == 0


def test_small_counts_are_nearly_exact(spark):
    for n in (1, 2, 10, 100):
        e = distinct.estimates(distinct.cells(spark.range(n).select(F.lit("a").alias("k"), F.col("id").cast("string").alias("h")), ["k"], F.col("h")), ["k"], [["k"]]).first().estimate
        assert abs(e - n) < 0.5 + 0.02 * n


# packing
def test_best_fit_against_a_plain_model():
    rng = random.Random(3)
    for _ in range(20):
        items = sorted(((rng.randint(1, 60), 1 << rng.randrange(4), rng.choice([0, 0, 1, 2])) for _ in range(120)), key=lambda x: -x[0])
        load, clusters, sources = {}, {}, {}
        for (n, s, c), b in zip(items, packing.best_fit(items, 100)):
            fits = [x for x in load if 100 - load[x] >= n and not clusters[x] & c]
            best = [x for x in fits if not sources[x] & s] or fits
            if b in load:  # no compatible bin was tighter, and none had to do without a compatible one
                assert b in best and load[b] == max(load[x] for x in best)
            else:
                assert not fits
            load[b], clusters[b], sources[b] = load.get(b, 0) + n, clusters.get(b, 0) | c, sources.get(b, 0) | s
        assert max(load.values()) <= 100


def docs(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    return df.withColumns({"size": F.lit(1), "shard": F.lit("x"), "tokens": F.lit("y"), "piece": F.lit(0)}) if extra else df


def test_every_token_is_packed_once(spark):
    rng = random.Random(5)
    texts = [" ".join(["word"] * rng.randint(1, 80)) for _ in range(300)] + [None, "", " ", "long " * 1_000] + ["same text here"] * 8
    targets = spark.createDataFrame([("a", 64), ("b", 200), ("none", None), ("zero", 0)], "pack_id string, capacity_tokens int")
    from brindle.llm.tokens import sized

    total = sized(docs(spark, texts)).agg(F.sum("tokens")).first()[0]
    p = packing.packed(spark, docs(spark, texts), targets, shard_items=100).cache()
    fill = {r.pack_id: r for r in packing.fill_report(p, targets, docs(spark, texts)).collect()}
    assert set(fill) == {"a", "b"} and all(r.tokens == total for r in fill.values()) and fill["b"].fill > 0.9 and all(r.same_text == 0 for r in fill.values())
    assert p.groupBy("pack_id", "container").agg(F.sum("tokens").alias("n")).join(targets, "pack_id").filter("n > capacity_tokens").count() == 0
    split = p.groupBy("pack_id", "doc_id").agg(F.count("*").alias("k"), F.sum("tokens").alias("n")).join(targets, "pack_id").filter("k > 1")
    assert split.filter("n <= capacity_tokens").count() == 0 and split.count() >= 2
    copies = p.filter(F.col("doc_id") >= 304).groupBy("pack_id", "container").count().filter("count > 1").count()
    assert copies == 0
    assert packing.packed(spark, docs(spark, texts).limit(0), targets).count() == 0


# mixing
def test_apportionment():
    assert mixing.sainte_lague([53, 24, 23], [99] * 3, 7) == [3, 2, 2]
    assert mixing.sainte_lague([1, 1], [2, 99], 10) == [2, 8] and mixing.sainte_lague([0, 1], [9, 9], 3) == [0, 3] and mixing.sainte_lague([1], [1], 5) == [1]


def test_total_lets_most_of_the_weight_reach_its_share():
    assert mixing.total_tokens([1, 1], [10, 30]) == 20 and mixing.total_tokens([95, 5], [95, 1]) == 100 and mixing.total_tokens([0, 1], [5, 0]) == 0 and mixing.total_tokens([], []) == 0


def test_shares_are_reached_and_reported(spark):
    texts = [" ".join(["tok"] * 20)] * 600
    df = spark.createDataFrame([(i, t, "big" if i < 500 else "mid" if i < 590 else "tiny") for i, t in enumerate(texts)] + [(900, None, "big"), (901, "", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "big", 2.0, 1), ("m", "mid", 1.0, 3), ("m", "tiny", 1.0, 2), ("m", "absent", 1.0, 4), ("m", "off", None, None)], "mix_id string, source string, weight double, max_repeats int")
    chosen, quotas = mixing.mixed(spark, df, targets, blocks=1_000, shard_items=100)
    r = {x.source: x for x in mixing.share_report(chosen, quotas).collect()}
    assert r["tiny"].most_copies == 2 and r["tiny"].tokens == 2 * r["tiny"].tokens_available and r["absent"].tokens == 0 and r["off"].tokens == 0
    assert all(x.most_copies <= x.max_repeats for x in r.values()) and sum(x.share for x in r.values()) == pytest.approx(1)
    assert r["mid"].share == pytest.approx(r["big"].share / 2, rel=0.1)
    assert mixing.mixed(spark, df.limit(0), targets)[0].count() == 0
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, mixing.mixed(spark, df.repartition(5), targets, blocks=1_000, shard_items=100)[0].collect()))


def test_used_up_sources_and_shards_lose_nothing(spark):
    rng = random.Random(7)
    texts = [("big", " ".join(["tok"] * rng.randint(20, 90))) for _ in range(1_500)] + [("tiny", " ".join(["tok"] * rng.randint(20, 90))) for _ in range(4)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.95, 1), ("m", "tiny", 0.05, 2), ("n", "big", 0.5, 1), ("n", "tiny", 0.5, 40)], "mix_id string, source string, weight double, max_repeats int")
    chosen, quotas = mixing.mixed(spark, df, targets, shard_items=50)
    r = {(x.mix_id, x.source): x for x in mixing.share_report(chosen, quotas).collect()}
    tiny = chosen.filter("mix_id = 'm' and source = 'tiny'").collect()
    assert len(tiny) == 4 and all(x.copies == 2 for x in tiny)
    assert r["m", "big"].tokens == r["m", "big"].tokens_available
    quota = quotas.filter("mix_id = 'n' and source = 'big'").agg(F.sum("quota")).first()[0]
    one = r["n", "big"].tokens_available / 1_500  # less than a document is left, not one for each of the 30 shards
    assert quota - one < r["n", "big"].tokens <= quota and r["n", "tiny"].most_copies <= 40
    assert r["n", "tiny"].tokens == 40 * r["n", "tiny"].tokens_available


@pytest.mark.parametrize("shards", [1, 100, 10_000])
def test_quotas_are_whole_at_any_number_of_shards(spark, shards):
    totals = spark.range(shards).select(F.explode(F.array(F.struct(F.lit("big").alias("source"), F.lit(40_000_000_000 // shards).alias("tokens")), F.struct(F.lit("small").alias("source"), F.lit(400_000 // shards + 3).alias("tokens")))).alias("s"), F.col("id").alias("shard")).select("s.*", "shard")
    claims = totals.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(spark.createDataFrame([("m", "big", 0.999, 1), ("m", "small", 0.001, 400)], "mix_id string, source string, weight double, max_repeats int"), "source")
    of = claims.groupBy("mix_id").applyInPandas(mixing._quotas(10_000, 0.9), "mix_id string, source string, target_share double, max_repeats int, whole bigint, n bigint, of bigint")
    quotas = mixing.shard_quotas(of, totals).cache()
    given = {r.source: r for r in quotas.groupBy("source").agg(F.sum("quota").alias("quota"), F.sum("blocks").alias("blocks"), F.max("target_share").alias("share")).collect()}
    whole = sum(r.quota for r in given.values())
    assert all(abs(r.quota / whole - r.share) < 0.001 for r in given.values()) and {r.source: r.of for r in of.collect()} == {s: r.quota for s, r in given.items()}
    assert given["big"].quota > 0.99 * 40_000_000_000 // shards * shards
    assert quotas.filter("quota > available * max_repeats").count() == 0


# sentences
CASES = [
    ("It rose. Then it fell!", ["It rose.", "Then it fell!"]), ("See Fig. 3 vs. No. 4, e.g. now. Done.", ["See Fig. 3 vs. No. 4, e.g. now.", "Done."]), ("The ratio fell to .64 or 3.5. Fine", ["The ratio fell to .64 or 3.5.", "Fine"]),
    ("“Try again. Or give up.” is what it said. Ok.", ["“Try again. Or give up.” is what it said.", "Ok."]), ('It printed "done." and hung. "The queue is full." The end.', ['It printed "done." and hung.', '"The queue is full."', "The end."]),
    ("It waited... and gave up. It grew... Nobody came.", ["It waited... and gave up.", "It grew...", "Nobody came."]), ("(It resets.) Every one.", ["(It resets.)", "Every one."]), ("Logs, traces, etc. The rest at 8 p.m. the same day.", ["Logs, traces, etc.", "The rest at 8 p.m. the same day."]),
    ("It was free.The next ran Batcher.Flush() once.", ["It was free.", "The next ran Batcher.Flush() once."]), ("What now?! Open https://a.b/flush?id=3.html today.", ["What now?!", "Open https://a.b/flush?id=3.html today."]), ("One line\nwrapped here. Next.\n\nBlock", ["One line\nwrapped here.", "Next.", "Block"]),
    ("## A. B. C!\nText. More.", ["## A. B. C!", "Text.", "More."]), ("- One. Two.\n* Three\n1. Four! Five.", ["- One. Two.", "* Three", "1. Four! Five."]), ("from main | where x(\"Stop! Wait.\") | head 3\n2025-10-01 10:00:00 INFO a. b! c", ["from main | where x(\"Stop! Wait.\") | head 3", "2025-10-01 10:00:00 INFO a. b! c"]),
    ("Am 3. Oktober stieg es, z. B. um 3 Uhr. „Voll. Warten.“ stand da. „Leer.“ Die Sicht.", ["Am 3. Oktober stieg es, z. B. um 3 Uhr.", "„Voll. Warten.“ stand da.", "„Leer.“", "Die Sicht."]), ("Voir la p. 5 ! « Plein. Non. » s'affiche. « Vide. » La vue.", ["Voir la p. 5 !", "« Plein. Non. » s'affiche.", "« Vide. »", "La vue."]),
    ("画面には「保存。再試行。」と出た。本当か？！「満杯です。」待った……諦めた。", ["画面には「保存。再試行。」と出た。", "本当か？！", "「満杯です。」", "待った……諦めた。"]), ("控制台显示“已满。请稍候。”的提示。“已满。”版本1.2把它改了。", ["控制台显示“已满。请稍候。”的提示。", "“已满。”", "版本1.2把它改了。"]),
    ("ระบบล้ม 3 ครั้ง งานค้าง", ["ระบบล้ม 3 ครั้ง", "งานค้าง"]), ("मान बदल गया। क्यों? \"भर गई। रुकिए।\" लिखा था।", ["मान बदल गया।", "क्यों?", "\"भर गई। रुकिए।\" लिखा था।"]), ("«ممتلئ. انتظر.» ظهرت هنا. انتهى؟ نعم.", ["«ممتلئ. انتظر.» ظهرت هنا.", "انتهى؟", "نعم."]), ("Хранятся журналы и т. д. Очередь, т. е. всё. См. стр. 5.", ["Хранятся журналы и т. д.", "Очередь, т. е. всё.", "См. стр. 5."]),
    ("«Полон. Ждите.»\n— написано там. См. рис.\n5. Очередь пуста.", ["«Полон. Ждите.»\n— написано там.", "См. рис.\n5.", "Очередь пуста."]),
    ("- one\n  goes on. Here.\n  - two\n    more\nafter. Next.", ["- one\n  goes on. Here.", "- two\n    more", "after.", "Next."]), ("1. a\n   b\n\n   c. D.", ["1. a\n   b", "c.", "D."]), ("* a\n* b\n# c\n  dog. Eel.", ["* a", "* b", "# c", "dog.", "Eel."]),
    ("Բարեւ։ Ինչպես։", ["Բարեւ։", "Ինչպես։"]), ("ሰላም። እንዴት።", ["ሰላም።", "እንዴት።"]), ("មួយ។ ពីរ។", ["មួយ។", "ពីរ។"]), ("တစ်။ နှစ်။", ["တစ်။", "နှစ်။"]), ("Gov. Smith paid Rs. 500. Done.", ["Gov. Smith paid Rs. 500.", "Done."]),
    ("", []), ("  \n\n ", []), (None, []), ('An "open quote. And more.', ['An "open quote.', "And more."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_units(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


def test_word_before_a_place_is_found_in_one_pass():
    import re

    rng = random.Random(11)
    for _ in range(300):
        t = "".join(rng.choice("ab1.. -x,") for _ in range(40))
        w = sentences._Words(t, 0)
        for i in range(1, 40):
            if t[i] == "." and rng.random() < 0.7:
                word = re.search(r"[\w.’'-]*$", t[:i])[0]
                first, dotted = w.before(i, 0)
                assert t[first:i] == word and dotted == ("." in word.strip("0123456789."))


def test_given_abbreviations(spark):
    df = spark.createDataFrame([(1, "It is abbr. Six. Seven.")], "doc_id bigint, text string")
    assert sentences.sentence_units(df).count() == 3 and sentences.sentence_units(df, ("abbr",)).count() == 2


def test_units_cover_the_text_and_scale(spark):
    rng = random.Random(9)
    parts = list("aB. !?\n\"()「。」«» ก1") + ["... ", "\n\n", "Fig. "]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        u = sentences.units(t)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in u)
        at = 0
        for a, b in [*u, (len(t), len(t))]:
            assert not t[at:a].strip() and a >= at
            at = b
    long = "A short one. " * 50_000
    df = spark.createDataFrame([(1, long), (1, None), (2, ""), (3, "Hi.")], "doc_id bigint, text string").withColumn("start_char", F.lit("clash"))
    assert sentences.sentence_units(df).count() == 50_001 and sentences.sentence_units(df.limit(0)).count() == 0

import re

import pytest
from pyspark.sql import functions as F

from eventlab.functions import text as X
from eventlab.operators import serving as S
from eventlab.operators import textcheck as C


def value(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return frame.select(expression.alias("v")).first()["v"]


def unmatched(spark, text, prompt):
    return value(spark, X.unmatched_numbers(F.col("t"), F.col("p")), t=text, p=prompt)


def test_numbers(spark):
    assert value(spark, X.extract_numbers(F.col("t")), t="certainty=81%, margin=0.44") == [81.0, 0.44]
    assert value(spark, X.extract_numbers(F.col("t")), t="2031-02-11: down -12.25%") == [2031.0, 2.0, 11.0, -12.25]


@pytest.mark.parametrize(
    "text, prompt, expected",
    [
        ("Its certainty is 55%.", "certainty=81%\nmargin=9.75", [55.0]),
        ("A margin near 3.7, call it 4.", "margin=3.68", []),
        ("Moves above 12% count.", "spike_means_above=0.12", []),
        ("The other class keeps 19%.", "certainty=81%", []),
        ("Filed on February 11, 2031.", "event_day=2031-02-11", []),
    ],
)
def test_faithfulness(spark, text, prompt, expected):
    assert unmatched(spark, text, prompt) == expected


@pytest.mark.parametrize(
    "text, flagged",
    [
        ("Shares will climb 11% by spring.", 1),
        ("After its last two reports the price went up 11%.", 0),
        ("No Spike is the class, and 81% is how sure the model is.", 0),
        ("To count as a spike, a day needs more than 12%.", 0),
        ("We expect a gain of 6.5% soon. Nice weather today. It should rise 2 %!", 2),
    ],
)
def test_forecast_leak(spark, text, flagged):
    got = value(spark, X.forecast_leaks(F.col("t")), t=text)
    assert len(got) == flagged
    if "spring" in text:
        assert "will climb 11%" in got[0]


@pytest.mark.parametrize(
    "text, flagged",
    [
        ("Shares will gain 4% again.", 1),
        ("In the past such a report went with a 4% gain.", 0),
        ("Shares will gain 8%.", 0),
    ],
)
def test_historical_confusion(spark, text, flagged):
    outcomes = F.array(F.lit(0.04), F.lit(None).cast("double"), F.lit(-0.11))
    assert len(value(spark, X.historical_confusions(F.col("t"), outcomes), t=text)) == flagged


@pytest.mark.parametrize("word, count", [("ship", 1), ("potato", 3), ("she", 1), ("stone", 1), ("?!", 0), ("pfft", 1), ("Quayside", 2)])
def test_syllables(spark, word, count):
    assert value(spark, X.syllable_count(X.spelled_words(F.col("t"))), t=word) == count


def brute_syllables(text):
    total = 0
    for raw in re.split(r"[ \t\r\n]+", text.lower()):
        word = re.sub("[^a-z]", "", raw)
        if word:
            groups = len(re.findall("[aeiouy]+", word))
            if word.endswith("e") and groups > 1:
                groups -= 1
            total += max(groups, 1)
    return total


def test_syllables_equal_brute_force_on_whole_documents(spark, small_dir):
    from eventlab.sources import market as K

    documents = K.table(spark, small_dir, "documents")
    spelled = X.spelled_words(F.col("text"))
    for r in documents.select("text", X.syllable_count(spelled).alias("n")).collect():
        assert r["n"] == brute_syllables(r["text"])


def test_readability(spark):
    # Two sentences, seven words, eleven syllables.
    text = "Potato ships dock. She counts every stone."
    syllables, words, sentences = brute_syllables(text), 7, 2
    scores = X.readability(F.col("t"))
    ease = 206.835 - 1.015 * words / sentences - 84.6 * syllables / words
    grade = 0.39 * words / sentences + 11.8 * syllables / words - 15.59
    assert value(spark, scores["flesch_reading_ease"], t=text) == pytest.approx(ease, abs=0.01)
    assert value(spark, scores["flesch_kincaid_grade"], t=text) == pytest.approx(grade, abs=0.01)
    assert value(spark, scores["flesch_reading_ease"], t="") is None
    assert value(spark, scores["flesch_reading_ease"], t="?! 77") is None


def recommendations(spark):
    import datetime as dt

    row = spark.createDataFrame(
        [("QZX", dt.date(2031, 2, 11), "Shipping", 1, 0.81, 0.44, 0.31, -29.5, 0.1325, 0.1475)],
        "symbol string, date date, sector string, y_pred int, y_pred_proba double, eps_estimate double, reported_eps double, "
        "surprise_pct double, target_t1_close_ret double, target_t1_high_ret double",
    )
    return S.describe_predictions(row, INPUTS, 0.12)


INPUTS = ["eps_estimate", "reported_eps", "surprise_pct"]


def test_prompt_holds_every_value(spark):
    prompt = S.render_prompt(recommendations(spark), INPUTS).first()["prompt"]
    facts = dict(line.split("=", 1) for line in prompt.split("FACTS:\n")[1].split("\n"))
    numbers = {f: float(facts.pop(f)) for f in (*INPUTS, "spike_means_above", "past_close_move", "past_high_move")}
    assert numbers == {
        "eps_estimate": 0.44, "reported_eps": 0.31, "surprise_pct": -29.5,
        "spike_means_above": 0.12, "past_close_move": 0.1325, "past_high_move": 0.1475,
    }
    assert facts == {"symbol": "QZX", "sector": "Shipping", "event_day": "2031-02-11", "class": "Spike", "certainty": "81%"}


def test_prompt_names_what_is_missing(spark):
    missing = recommendations(spark).withColumn("sector", F.lit(None).cast("string")).withColumn("spike_threshold", F.lit(None).cast("double"))
    prompt = S.render_prompt(missing, INPUTS).first()["prompt"]
    assert "sector=unknown" in prompt and "spike_means_above=unknown" in prompt


def test_fallback_passes_all_checks(spark):
    told = S.render_fallback(S.render_prompt(recommendations(spark), INPUTS))
    row = C.check_explanations(told).first()
    for part in ("QZX", "Spike", "81%", "2031-02-11"):
        assert part in row["explanation"]
    assert (row["unmatched_numbers"], row["forecast_leaks"], row["historical_confusions"]) == ([], [], [])
    summary = C.advice_summary(C.check_explanations(told)).first()
    assert (summary["texts"], summary["faithful_rate"]) == (1, 1.0)


def test_reply_pairs(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (2, 0, "user", "d")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    assert [tuple(r) for r in C.reply_pairs(turns).select("prompt", "explanation").collect()] == [("a", "b")]

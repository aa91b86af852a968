"""Queries on explanation texts, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlab.functions import text as X
from eventlab.functions.scalars import to_places
from eventlab.operators import events as E
from eventlab.operators import resample as R
from eventlab.operators import serving as S
from eventlab.operators import textcheck as C
from eventlab.schemas import FEATURES
from eventlab.sources import market as K

from .ctes import with_ctes
from .shape import r6, r6_all, tidy


def _join_numbers(column):
    return F.array_join(F.transform(column, lambda v: F.format_string("%.6f", v)), ",")


def _recommended(spark, sf):
    """The rule score's recommendation for every ticker's latest event."""
    scored = K.rule_score(E.latest_event(K.features(spark, sf)))
    return S.describe_predictions(scored, FEATURES, K.THRESHOLD)


def render_prompt(spark, sf):
    return S.render_prompt(_recommended(spark, sf)).select("ticker", "prompt")


def render_fallback(spark, sf):
    return S.render_fallback(_recommended(spark, sf)).select("ticker", "explanation")


def recommendation_rule(spark, sf):
    rows = _recommended(spark, sf)
    return tidy(
        rows.select(
            "ticker",
            "as_of_date",
            "sector",
            "predicted_class",
            "predicted_label",
            "confidence",
            "spike_threshold",
            F.element_at("feature_values", F.lit("surprise_pct")).alias("surprise_pct"),
            F.col("historical_outcome.close_ret").alias("close_ret"),
        )
    )


def _percent_text(value):
    return F.format_string("%.4f", to_places(value * 100, 4))


def _explanations(spark, sf):
    """Explanations of every event, true and false in turn, by symbol."""
    scored = K.rule_score(K.features(spark, sf))
    rows = S.render_prompt(S.describe_predictions(scored, FEATURES, K.THRESHOLD))
    close = _percent_text(F.abs("historical_outcome.close_ret"))
    kind = F.col("ticker") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("The stock will move "), close, F.lit("% soon. Nothing else is known.")))
        .when(kind == 1, F.concat(F.lit("Historically the close moved "), close, F.lit("% after this event.")))
        .when(kind == 2, F.lit("The model predicts no spike, with 73.5% confidence."))
        .when(kind == 3, F.lit("A move of more than 7% is unlikely. It rose before."))
        .when(kind == 4, F.concat(F.lit("Shares are likely to gain 41.25%! The event was on "), F.col("as_of_date").cast("string"), F.lit(".")))
        .otherwise(F.lit("Spikes like this are rare."))
    )
    return rows.withColumn("explanation", text)


def _checked(spark, sf):
    return C.check_explanations(_explanations(spark, sf))


def advice_eval(spark, sf):
    return tidy(
        _checked(spark, sf).select(
            "ticker",
            "as_of_date",
            "explanation",
            _join_numbers(F.col("unmatched_numbers")).alias("unmatched_numbers"),
            F.array_join("forecast_leaks", "|").alias("forecast_leaks"),
            F.array_join("historical_confusions", "|").alias("historical_confusions"),
            "flesch_reading_ease",
            "flesch_kincaid_grade",
        )
    )


def advice_summary(spark, sf):
    return tidy(C.advice_summary(_checked(spark, sf)))


def advice_sample(spark, sf):
    """The checks of the latest event of 30 sampled tickers."""
    rows = _checked(spark, sf).withColumnsRenamed({"ticker": "symbol", "as_of_date": "date"})
    sample = R.seeded_ticker_sample(rows, 30)
    latest = E.latest_event(rows.select("symbol", "date", "unmatched_numbers", "forecast_leaks", "flesch_reading_ease"))
    return tidy(
        latest.join(sample, "symbol").select(
            "symbol",
            "date",
            F.size("unmatched_numbers").alias("unmatched"),
            F.size("forecast_leaks").alias("leaks"),
            "flesch_reading_ease",
        )
    )


def extract_numbers(spark, sf):
    documents = K.table(spark, sf, "documents")
    return documents.select("doc_id", _join_numbers(X.extract_numbers(F.col("text"))).alias("numbers"))


def faithfulness(spark, sf):
    pairs = C.reply_pairs(K.table(spark, sf, "conversations"))
    invented = X.unmatched_numbers(F.col("explanation"), F.col("prompt"))
    return pairs.select("conv_id", "turn", _join_numbers(invented).alias("unmatched_numbers"))


def forecast_leak(spark, sf):
    documents = K.table(spark, sf, "documents")
    flagged = X.forecast_leaks(F.col("text"))
    return tidy(documents.select("doc_id", F.size(flagged).alias("leaks"), F.array_join(flagged, "|").alias("sentences")))


def historical_confusion(spark, sf):
    rows = _explanations(spark, sf)
    outcomes = F.array("historical_outcome.close_ret", "historical_outcome.high_ret")
    flagged = X.historical_confusions(F.col("explanation"), outcomes)
    return rows.select("ticker", "as_of_date", F.array_join(flagged, "|").alias("sentences"))


def readability(spark, sf):
    documents = K.table(spark, sf, "documents")
    scores = X.readability(F.col("text"))
    return tidy(documents.select("doc_id", *[c.alias(n) for n, c in scores.items()]))


def syllables(spark, sf):
    spelled = X.spelled_words(F.col("text"))
    conversations = K.table(spark, sf, "conversations")
    return tidy(
        conversations.select(
            "conv_id", "turn", X.word_count(spelled).alias("words"), X.syllable_count(spelled).alias("syllables")
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        render_prompt, render_fallback, recommendation_rule, advice_eval, advice_summary, advice_sample,
        extract_numbers, faithfulness, forecast_leak, historical_confusion, readability, syllables,
    )
}

TOKENS = f"regexp_extract_all(regexp_replace({{0}}, '([0-9])-', '\\1 ', 'g'), '{X.NUMBER}')"
SENTENCES = f"list_filter(regexp_split_to_array({{0}}, '{X.SENTENCE_END}'), lambda s: trim(s) <> '')"


def _numbers(array: str) -> str:
    return f"array_to_string(list_transform({array}, lambda v: printf('%.6f', v::DOUBLE)), ',')"


def _close(token: str, candidate: str) -> str:
    decimals = f"CASE WHEN strpos({token}, '.') > 0 THEN length({token}) - strpos({token}, '.') ELSE 0 END"
    return f"abs({token}::DOUBLE - ({candidate})) <= 0.5 * pow(10.0::DOUBLE, -({decimals})) + 1e-9"


def _invented(text: str, prompt: str) -> str:
    matches = " OR ".join(_close("t", c) for c in ("g", "g * 100", "100 - g", "100 - g * 100"))
    given = f"list_transform({TOKENS.format(prompt)}, lambda x: x::DOUBLE)"
    return f"list_filter({TOKENS.format(text)}, lambda t: len(list_filter({given}, lambda g: {matches})) = 0)"


def _flagged(text: str, test: str) -> str:
    return (
        f"list_filter({SENTENCES.format(text)}, lambda s: regexp_matches(lower(s), '{X.FORWARD}') "
        f"AND NOT regexp_matches(lower(s), '{X.HISTORICAL}') AND {test})"
    )


LEAK = f"(regexp_matches(s, '{X.PERCENTAGE}') AND NOT regexp_matches(lower(s), '{X.CONFIDENCE}'))"
PLAIN = "replace(t, '-', '')"
CONFUSED = (
    f"len(list_filter({TOKENS.format('s')}, lambda t: len(list_filter([close_ret, high_ret], lambda o: "
    f"o IS NOT NULL AND ({_close(PLAIN, 'abs(o)')} OR {_close(PLAIN, 'abs(o) * 100')}))) > 0)) > 0"
)


def _readability(text: str) -> str:
    words = f"list_filter(list_transform(regexp_split_to_array(lower({text}), '[ \\t\\r\\n]+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w <> '')"
    vowels = "len(regexp_extract_all(w, '[aeiouy]+'))"
    per_word = f"list_transform({words}, lambda w: greatest(CASE WHEN w[-1] = 'e' AND {vowels} > 1 THEN {vowels} - 1 ELSE {vowels} END, 1))"
    return f"""len({words}) AS words, coalesce(list_sum({per_word}), 0)::BIGINT AS syllables, len({SENTENCES.format(text)}) AS sentences"""


EASE = "206.835::DOUBLE - 1.015::DOUBLE * (words::DOUBLE / nullif(sentences, 0)) - 84.6::DOUBLE * (syllables::DOUBLE / nullif(words, 0))"
GRADE = "0.39::DOUBLE * (words::DOUBLE / nullif(sentences, 0)) + 11.8::DOUBLE * (syllables::DOUBLE / nullif(words, 0)) - 15.59::DOUBLE"
N = "CASE WHEN {0} IS NULL THEN 'unknown' ELSE printf('%.6f', floor({0} * 1e6 + 0.5) / 1e6) END"
CONFIDENCE = "CASE WHEN y_pred = 1 THEN y_pred_proba ELSE 1 - y_pred_proba END"
LABEL = "CASE WHEN y_pred = 1 THEN 'Spike' ELSE 'No Spike' END"
RECOMMENDED = f"""SELECT symbol AS ticker, date AS as_of_date, sector, y_pred AS predicted_class, {LABEL} AS predicted_label,
    {CONFIDENCE} AS confidence, CAST(floor(({CONFIDENCE}) * 100 + 0.5) AS BIGINT) || '%' AS percent,
    eps_estimate, reported_eps, surprise_pct, return_60d, sector_rank_60d,
    target_t1_close_ret AS close_ret, target_t1_high_ret AS high_ret FROM scored"""
LATEST = """SELECT * FROM recommended QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of_date DESC) = 1"""
PROMPT = "concat_ws(chr(10), " + ", ".join(
    [
        *["'" + rule.replace("'", "''") + "'" for rule in S.RULES],
        "'symbol=' || ticker",
        "'sector=' || sector",
        "'event_day=' || as_of_date",
        *[f"'{f}=' || {N.format(f)}" for f in FEATURES],
        "'spike_means_above=0.070000'",
        "'class=' || predicted_label",
        "'certainty=' || percent",
        f"'past_close_move=' || {N.format('close_ret')}",
        f"'past_high_move=' || {N.format('high_ret')}",
    ]
) + ")"
CLOSE_TEXT = "printf('%.4f', floor((abs(close_ret) * 100) * 1e4 + 0.5) / 1e4)"
EXPLAINED = f"""SELECT *, {PROMPT} AS prompt, CASE ticker % 6
    WHEN 0 THEN 'The stock will move ' || {CLOSE_TEXT} || '% soon. Nothing else is known.'
    WHEN 1 THEN 'Historically the close moved ' || {CLOSE_TEXT} || '% after this event.'
    WHEN 2 THEN 'The model predicts no spike, with 73.5% confidence.'
    WHEN 3 THEN 'A move of more than 7% is unlikely. It rose before.'
    WHEN 4 THEN 'Shares are likely to gain 41.25%! The event was on ' || as_of_date || '.'
    ELSE 'Spikes like this are rare.' END AS explanation FROM recommended"""
CHECKED = f"""SELECT *, {EASE} AS ease, {GRADE} AS grade FROM (SELECT *, {_invented('explanation', 'prompt')} AS invented,
    {_flagged('explanation', LEAK)} AS leaks, {_flagged('explanation', CONFUSED)} AS confusions,
    {_readability('explanation')} FROM explained)"""
TEXTS = {"recommended": RECOMMENDED, "latest": LATEST, "explained": EXPLAINED, "checked": CHECKED}
PASSED = {"faithful": "invented", "no_leak": "leaks", "no_confusion": "confusions"}

SQL = {
    "render_prompt": with_ctes(f"SELECT ticker, {PROMPT} AS prompt FROM latest", TEXTS),
    "render_fallback": with_ctes(
        """SELECT ticker, predicted_label || ' is what the model gives ' || ticker || ' (' || percent || ' certain), judging by its report of '
        || as_of_date || '; nothing newer went into this.' AS explanation FROM latest""",
        TEXTS,
    ),
    "recommendation_rule": with_ctes(
        f"""SELECT ticker, as_of_date, sector, CAST(predicted_class AS BIGINT) AS predicted_class, predicted_label,
        {r6('confidence')}, 0.07::DOUBLE AS spike_threshold, {r6_all('surprise_pct', 'close_ret')} FROM latest""",
        TEXTS,
    ),
    "advice_eval": with_ctes(
        f"""SELECT ticker, as_of_date, explanation, {_numbers('invented')} AS unmatched_numbers,
        array_to_string(leaks, '|') AS forecast_leaks, array_to_string(confusions, '|') AS historical_confusions,
        {r6('ease', 'flesch_reading_ease')}, {r6('grade', 'flesch_kincaid_grade')} FROM checked""",
        TEXTS,
    ),
    "advice_summary": with_ctes(
        "SELECT count(*) AS texts, "
        + ", ".join(f"count(CASE WHEN len({c}) = 0 THEN 1 END) AS n_{n}" for n, c in PASSED.items())
        + ", "
        + ", ".join(r6(f"avg(CASE WHEN len({c}) = 0 THEN 1.0::DOUBLE ELSE 0 END)", f"{n}_rate") for n, c in PASSED.items())
        + f", {r6('avg(ease)', 'mean_reading_ease')}, {r6('avg(grade)', 'mean_grade')} FROM checked",
        TEXTS,
    ),
    "advice_sample": with_ctes(
        f"""SELECT ticker AS symbol, as_of_date AS date, len(invented) AS unmatched, len(leaks) AS leaks,
        {r6('ease', 'flesch_reading_ease')} FROM (SELECT * FROM checked
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of_date DESC) = 1)
        WHERE ticker IN (SELECT ticker FROM (SELECT DISTINCT ticker FROM recommended)
            ORDER BY md5(concat_ws('|', 42, ticker)), ticker LIMIT 30)""",
        TEXTS,
    ),
    "extract_numbers": f"SELECT doc_id, {_numbers(TOKENS.format('text'))} AS numbers FROM documents",
    "faithfulness": f"""SELECT a.conv_id, a.turn, {_numbers(_invented('a.text', 'u.text'))} AS unmatched_numbers
        FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
        WHERE a.role = 'assistant' AND u.role = 'user'""",
    "forecast_leak": f"""SELECT doc_id, len(f) AS leaks, array_to_string(f, '|') AS sentences
        FROM (SELECT doc_id, {_flagged('text', LEAK)} AS f FROM documents)""",
    "historical_confusion": with_ctes(
        f"SELECT ticker, as_of_date, array_to_string({_flagged('explanation', CONFUSED)}, '|') AS sentences FROM explained",
        TEXTS,
    ),
    "readability": f"""SELECT doc_id, {r6(EASE, 'flesch_reading_ease')}, {r6(GRADE, 'flesch_kincaid_grade')}
        FROM (SELECT doc_id, {_readability('text')} FROM documents)""",
    "syllables": f"SELECT conv_id, turn, words, syllables FROM (SELECT conv_id, turn, {_readability('text')} FROM conversations)",
}

"""The named queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions import dates, labels, long, spans, subwords
from textveil.functions.patterns import PATTERNS
from textveil.operators import bio, detectors, latency, masking, responder, restore, roundtrip, scoring, tagger
from textveil.sources import synthetic, tables
from textveil.sources import text as texts
from textveil.sources.notes import SURNAMES, drawn, many, notes, rendered

SECRET, DAYS = "example secret", 10
VOCABULARY_WORDS = ["record", "patient", "clinic", "claims", "account", "example", "portal", "partner", "device", "dates"]
#: Documents on which the best epoch is chosen at most.
TRIED = 1000
#: Synthetic notes of the evaluation set.
EVALUATED = 2000
FAILING = ["nowhere", "anthropic", "openai_compatible"]
Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def flat(df: DataFrame, column: str = "spans", *keys: str) -> DataFrame:
    """A row for each span, with its part of the text."""
    told = df.withColumn("_chunks", F.expr(long.chunks("text"))).select(*keys, "doc_id", spans.parts("text", column, "_chunks").alias("_told"))
    # inline_outer: for inline the optimiser would compute the whole array a second time, in a filter on its size
    rows = told.select(*keys, "doc_id", F.inline_outer("_told")).where("label is not null")
    return rows.select(*keys, "doc_id", *(F.col(c).cast("long") for c in ("s", "e")), "label", "part")


def source(table: str) -> Query:
    return {"documents": documents, "notes": notes}[table]


def label_spans(pattern: str, table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of one grammar, before other grammars claim characters."""
    rows = source(table)(spark, sf_dir).withColumn("spans", spans.candidates("text", {pattern}))
    return flat(rows.withColumn("spans", F.expr("transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'label', x.label))")))


def detect_all(table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spans.with_spans(source(table)(spark, sf_dir)))


def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return flat(spans.with_spans(pages))


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that lost their characters, counted by label and prio."""
    staged = notes(spark, sf_dir).withColumn("found", spans.candidates("text")).withColumn("won", spans.claim("found"))
    lost = F.expr("filter(found, c -> not exists(won, w -> w.s = c.s and w.e = c.e and w.label = c.label))")
    return staged.select(F.inline_outer(lost)).where("label is not null").groupBy("label").agg(F.count("*").alias("lost"))


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = documents(spark, sf_dir).select("text").unionByName(notes(spark, sf_dir).select("text"))
    return spans.with_spans(every).select(F.inline_outer("spans")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("chars"))


def docs_with_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.with_spans(documents(spark, sf_dir))
    return found.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.size("spans") > 0).alias("with_identifiers"))


def doc_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", dates.keyed_shift(F.col("doc_id"), SECRET).cast("long").alias("days"))


def date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat(spans.with_spans(notes(spark, sf_dir))).where("label = 'DATE'")
    return rows.select("doc_id", "s", "part", F.expr(f"cast({dates.parsed('part')} as string)").alias("day"), F.expr(dates.shifted("part", str(DAYS))).alias("moved"))


def date_interval_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between the first and last readable date of a note, before and after a keyed shift."""
    rows = flat(spans.with_spans(notes(spark, sf_dir))).where("label = 'DATE'").withColumn("shift", dates.keyed_shift(F.col("doc_id"), SECRET))
    both = rows.select("doc_id", F.expr(dates.parsed("part")).alias("a"), F.expr(dates.shifted("part", "shift")).alias("moved"))
    both = both.select("doc_id", "a", F.expr(dates.parsed("moved")).alias("b")).where("a is not null and b is not null")
    gap = lambda c: F.datediff(F.max(c), F.min(c)).cast("long")
    return both.groupBy("doc_id").agg(gap("a").alias("days_before"), gap("b").alias("days_after"))


def _masked(table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask(spans.with_spans(source(table)(spark, sf_dir)).withColumn("shift", F.lit(DAYS)))


def mask_table(table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(table, spark, sf_dir).select("doc_id", "masked")


def mask_selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.selfcheck(_masked("notes", spark, sf_dir)).select("doc_id", "masked", F.size("leaks").cast("long").alias("leaks"))


def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mapping(_masked("notes", spark, sf_dir), "doc_id").withColumn("ordinal", F.col("ordinal").cast("long"))


def pseudonym_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _masked("notes", spark, sf_dir).select("doc_id", F.inline_outer("items")).where("m like '[%'")
    return rows.select("doc_id", F.col("s").cast("long").alias("s"), "label", F.col("m").alias("token"))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked notes as responses; in every seventh the first pseudonyms are replaced by ones that no mapping knows."""
    done = _masked("notes", spark, sf_dir)
    return done.select("doc_id", _swapped(F.col("masked")).alias("response"), masking.entries().alias("entries"))


def _swapped(response: Column) -> Column:
    return F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(response, "_1\\]", "_91]")).otherwise(response)


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of notes, some without a source, through the round trip.

    Sources are named on narrow rows, before the texts are made: texts would move through ranges of the batch, which are as
    many at every size, and be worked on in these.
    """
    rows = drawn(spark, sf_dir).withColumn("source", F.when(F.col("o_orderkey") % 3 != 0, F.col("n_name")))
    told = texts.named(rows, "o_orderkey").withColumnRenamed("source", "_source")
    rows = rendered(told, many(spark, sf_dir)).select("doc_id", "text", F.col("_source").alias("source"))
    return roundtrip.run(rows, texts.QUESTION, SECRET, lambda p: _swapped(restore.dry_run(p)), check=False, shift_days=DAYS)


def roundtrip_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("doc_id", "source", "response", "restored", F.size("warnings").cast("long").alias("warnings"))


def roundtrip_warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip.warned(_batch(spark, sf_dir))


def roundtrip_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip.transcripts(_batch(spark, sf_dir))


def _providers() -> responder.Caller:
    """No call succeeds: a fourth of the documents each asks no one, an unknown provider, one whose key is missing, and a closed port."""
    closed = responder.PROVIDERS["openai_compatible"]._replace(url="http://127.0.0.1:9/v1")
    chosen = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, FAILING)), (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int"))
    return responder.Caller(chosen, {"anthropic": responder.PROVIDERS["anthropic"], "openai_compatible": closed}, keys={}, retries=0)


def roundtrip_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents of a batch get if their provider can't be asked, and why."""
    rows = notes(spark, sf_dir).select("doc_id", "text", "source")
    done = roundtrip.run(rows, texts.QUESTION, SECRET, _providers(), check=False, shift_days=DAYS)
    return done.select("doc_id", "answer.provider", "response", "answer.error", "answer.fell_back", responder.hint(F.col("answer.error")).isNotNull().alias("hinted"), "restored")


def roundtrip_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each stage how many documents were timed, and whether its figures are in order and within the totals."""
    rows = notes(spark, sf_dir).select("doc_id", "text", "source")
    stacked = roundtrip.timings(roundtrip.timed(rows, texts.QUESTION, SECRET), "timing.total")
    within = (F.col("seconds") >= 0) & (F.col("seconds") <= F.col("total"))
    measured = latency.summary(stacked, "stage", "seconds", F.every(within).alias("within"))
    ordered = (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("max_s")) & (F.col("mean_s") <= F.col("max_s"))
    return measured.select("stage", "n", ordered.alias("ordered"), "within")


def roundtrip_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with the self-check and each document's own shift of dates."""
    done = roundtrip.run(notes(spark, sf_dir).select("doc_id", "text", "source"), texts.QUESTION, SECRET)
    return done.select("doc_id", "masked", "leaks", F.col("shift").cast("long").alias("shift"))


def rehydrate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("doc_id", restore.rehydrated().alias("restored"))


def rehydrate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answered(spark, sf_dir).select("doc_id", F.posexplode(restore.warnings()).alias("place", "token"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "token")


def roundtrip_dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked("notes", spark, sf_dir).select("doc_id", restore.dry_run(restore.prompt("masked", F.lit(texts.QUESTION))).alias("response"))


def _surname_spans(docs: DataFrame) -> DataFrame:
    """A stand-in for a model: doctors with a known surname, and the countries that name a note's source."""
    doctor = spans.matches("text", r"Dr\. (?:" + "|".join(SURNAMES) + ")")
    place = "if(instr(text, source) > 0, array(named_struct('s', instr(text, source) - 1, 'm', source)), cast(array() as array<struct<s: int, m: string>>))"
    shaped = "transform({}, x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'label', '{}'))"
    return docs.withColumn("model", F.expr(f"concat({shaped.format(doctor, 'NAME')}, {shaped.format(place, 'LOCATION')})"))


def _detectors(rows: DataFrame) -> DataFrame:
    return _surname_spans(spans.with_spans(rows)).withColumn("ensemble", spans.ensemble("spans", "model"))


def _stacked(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each document and each of three detectors, with what it found."""
    listed = ", ".join(f"named_struct('detector', '{name}', 'found', {column})" for name, column in (("regex", "spans"), ("model", "model"), ("ensemble", "ensemble")))
    return _detectors(rows).select(*keys, "doc_id", "gold", F.expr(f"explode(array({listed})) as d")).select(*keys, "doc_id", "d.detector", "d.found", "gold")


def ensemble_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_detectors(notes(spark, sf_dir)), "ensemble")


def normalise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign labels of the same spans, renamed by a join with the fixed table; those without a name of ours go."""
    back = {ours: theirs for theirs, ours in labels.FOREIGN.items()} | {"MRN": "MEDICAL_RECORD", "AGE": "AGE"}
    foreign = F.create_map(*(F.lit(x) for pair in back.items() for x in pair))
    rows = flat(spans.with_spans(notes(spark, sf_dir))).select("doc_id", "s", F.coalesce(F.try_element_at(foreign, F.col("label")), F.lit("OTHER")).alias("foreign"))
    table = spark.createDataFrame(list(labels.FOREIGN.items()), "foreign string, label string")
    return rows.join(F.broadcast(table), "foreign").groupBy("foreign", "label").agg(F.count("*").alias("n"))  # ten rows


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of three detectors in one pass over the notes."""
    both = _stacked(notes(spark, sf_dir)).withColumn("found", F.array_distinct("found"))
    listed = F.expr("""concat(transform(found, x -> named_struct('s', x.s, 'e', x.e, 'label', x.label, 'kind', if(exists(gold, g -> g = x), 'tp', 'fp'))),
        transform(filter(gold, g -> not exists(found, x -> x = g)), x -> named_struct('s', x.s, 'e', x.e, 'label', x.label, 'kind', 'fn')))""")
    return both.select("detector", "doc_id", F.inline_outer(listed)).where("label is not null")


def _tidy(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def score_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(scoring.overall(_scored(spark, sf_dir), ("detector",)))


def evaluation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval_set, doc_id, text, source, gold of the notes, the synthetic notes kept for evaluation, and the marked gold documents."""
    marked = {"notes": notes(spark, sf_dir), "synthetic": synthetic.generate(spark, EVALUATED, split="eval"), "gold": texts.gold(spark).drop("source")}
    named = (rows.withColumnRenamed("entities", "gold").withColumn("eval_set", F.lit(name)).select("eval_set", "doc_id", "text", *(["source"] if name == "notes" else []), "gold") for name, rows in marked.items())
    return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), named)


def score_by_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector on every evaluation set, with the documents that it leaves leaking."""
    return _tidy(scoring.report(_stacked(evaluation_sets(spark, sf_dir), "eval_set"), ("eval_set", "detector")))


def score_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(scoring.per_label(_scored(spark, sf_dir), ("detector",)))


def score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern detector's, by the table form of the scorer."""
    staged = spans.with_spans(notes(spark, sf_dir))
    return _tidy(scoring.overall(scoring.verdicts(*(staged.select("doc_id", F.inline_outer(c)).where("label is not null") for c in ("spans", "gold")))))


def score_leak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(scoring.leak_rate(_scored(spark, sf_dir).where("detector = 'regex'"), notes(spark, sf_dir)))


def missed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the first eight."""
    found = scoring.missed(_scored(spark, sf_dir).where("detector = 'regex'"), notes(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("long") for c in ("s", "e")})


def gold_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(texts.gold(spark), "entities")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(latency.summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value"))


def bio_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = bio.align(notes(spark, sf_dir), "gold")
    return tagged.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("pos", "ts", "te", "tag_id")), "tag")


def bio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the tags of regex spans against those of gold tags."""
    both = bio.entities(spans.with_spans(notes(spark, sf_dir)), ["spans", "gold"])
    return _tidy(scoring.report(both, (), "spans", "gold").select("tp", "fp", "fn", "p", "r", "f1"))


def vocabulary() -> list[str]:
    """A small vocabulary by rule: single letters, digits and signs, and every part of three and four letters of some words, each as the beginning and inside of words."""
    bare = [chr(k) for k in range(33, 127) if chr(k).lower() == chr(k)] + sorted({w[k : k + n] for w in VOCABULARY_WORDS for n in (3, 4) for k in range(len(w) - n + 1)})
    return [subwords.PADDING, subwords.UNKNOWN, subwords.FIRST, subwords.LAST, *bare, *(subwords.INSIDE + piece for piece in bare)]


def _pieces(rows: DataFrame, spans_: str, padded: bool = True) -> DataFrame:
    """doc_id and tagged, the array of a note's sub-words with their tags."""
    cut = subwords.add(rows.select("doc_id", "text", spans_), bio.tokens(), vocabulary(), padded=padded)
    return bio.tagged(cut, spans_, cut=F.col("pieces"))


def bio_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 256 sub-words of each note: pieces and tag ids of those that stand for text, and how many don't."""
    rows = _pieces(notes(spark, sf_dir), "gold").withColumn("x", F.expr("filter(tagged, x -> x.word is not null)"))
    others, wrong = F.expr("cast(size(tagged) - size(x) as bigint) as others"), F.expr("cast(size(filter(tagged, x -> x.word is null and x.tag_id > 0)) as bigint) as wrong")
    return rows.select("doc_id", F.expr("array_join(x.piece, ' ')").alias("pieces"), F.expr("array_join(x.tag_id, ' ')").alias("tags"), others, wrong)


def subword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that take the tag of their best sub-word; scores and losses of tags stand in for a model's."""
    lost = "(doc_id + x.pos) % 5 = 0"
    score = "(doc_id * 3 + x.pos * 7) % 97 / 97"
    told = f"transform(filter(tagged, x -> x.word is not null), x -> named_struct('ts', x.ts, 'te', x.te, 'word', x.word, 'tag', if({lost}, 'O', x.tag), 'tag_id', if({lost}, 0, x.tag_id), 'score', {score}))"
    scored = _pieces(notes(spark, sf_dir), "gold", padded=False).select("doc_id", F.expr(told).alias("tagged"))
    runs = bio.merged(scored).select("doc_id", F.inline_outer("spans")).where("label is not null")
    return runs.select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "label")


def tagger_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger fitted on a bounded part of four fifths of the notes: its scores, and those of the ensemble, on these and on the rest."""
    rows = notes(spark, sf_dir).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    learnt, tried = rows.where("not held_out"), rows.where("not held_out and doc_id % 3 = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRIED)
    model, _ = tagger.fit(learnt, tried, epochs=4)
    # every note is tagged once, and both detectors are scored on both parts in that pass
    found = tagger.detector(model)(rows, "text", "tagger")
    both = spans.with_spans(found, "text", "_first").withColumn("ensemble", spans.ensemble("_first", "tagger"))
    stacked = both.select("held_out", "gold", F.expr("stack(2, 'tagger', tagger, 'ensemble', ensemble) as (detector, found)"))
    names = spark.createDataFrame([(d, h) for d in ("tagger", "ensemble") for h in (False, True)], "detector string, held_out boolean")
    counted = scoring.report(stacked, ("detector", "held_out")).drop("docs", "leaking", "leak_rate")
    return _tidy(names.join(counted, ["detector", "held_out"], "left").na.fill(0))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.class_weights(spark).withColumn("tag_id", F.col("tag_id").cast("long"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for a model's output: 35 numbers for every event, and a gold tag, which some have not."""
    numbers = F.expr(f"transform(sequence(0, {len(labels.TAGS) - 1}), k -> cast((event_id * (k + 3) + k * k) % 17 as double) / 4)")
    gold = F.expr(f"if(event_id % 11 = 0, {bio.IGNORED}, cast(event_id % {len(labels.TAGS)} as int))")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", numbers.alias("logits"), gold.alias("tag_id"))


def argmax_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).selectExpr("event_id", f"cast({bio.argmax_tags('array(logits)')}[0] as bigint) as tag_id")


def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(bio.weighted_loss(_logits(spark, sf_dir)))


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the events as epochs: the first one with the highest mean value, in hundredths."""
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    log = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(day.alias("ord")).agg(F.round(F.avg("value") / 100, 2).alias("recall"))
    return latency.best_epoch(log.withColumn("epoch", F.col("ord").cast("double")))


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with identifiers by role: a check that finds nothing if all is well."""
    turns = spans.with_spans(tables.read(spark, sf_dir, "conversations"))
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.size("spans") > 0).alias("with_hits"))


def _synthetic(spark: SparkSession) -> DataFrame:
    """Synthetic notes of both pools."""
    both = [synthetic.generate(spark, 2000, split=s).withColumn("split", F.lit(s)) for s in ("train", "eval")]
    return both[0].unionByName(both[1])


def synth_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the parts that are tagged, in order."""
    tagged = F.expr("array_join(transform(entities, x -> concat(x.label, '=', substring(text, x.s + 1, x.e - x.s))), '|')")
    return _synthetic(spark).select("split", "doc_id", F.col("template_id").cast("long").alias("template_id"), "text", tagged.alias("tagged"))


def synth_label_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthetic(spark).select("split", F.inline("entities")).groupBy("split", "label").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    **{f"spans_{p.label.lower()}": partial(label_spans, p.label, "documents" if p.label in ("EMAIL", "IP") else "notes") for p in PATTERNS},
    "detect_all_documents": partial(detect_all, "documents"),
    "detect_all_notes": partial(detect_all, "notes"),
    "detect_pages": detect_pages,
    "claim_conflicts": claim_conflicts,
    "label_histogram": label_histogram,
    "docs_with_identifiers_by_lang": docs_with_identifiers,
    "doc_shift": doc_shift,
    "date_shift": date_shift,
    "date_interval_preserved": date_interval_preserved,
    "mask_documents": partial(mask_table, "documents"),
    "mask_notes": partial(mask_table, "notes"),
    "mask_notes_selfcheck": mask_selfcheck,
    "mapping_table": mapping_table,
    "pseudonym_ids": pseudonym_ids,
    "rehydrate_notes": rehydrate_notes,
    "rehydrate_warnings": rehydrate_warnings,
    "roundtrip_dry": roundtrip_dry,
    "roundtrip_batch": roundtrip_batch,
    "roundtrip_warned": roundtrip_warned,
    "roundtrip_transcripts": roundtrip_transcripts,
    "roundtrip_fallback": roundtrip_fallback,
    "roundtrip_timings": roundtrip_timings,
    "roundtrip_checked": roundtrip_checked,
    "ensemble_spans": ensemble_spans,
    "normalise_labels": normalise_labels,
    "score_overall": score_overall,
    "score_by_detector": score_by_detector,
    "score_by_evaluation": score_by_evaluation,
    "score_per_label": score_per_label,
    "score_leak_rate": score_leak_rate,
    "missed_sample": missed_sample,
    "gold_locate": gold_locate,
    "latency_percentiles": latency_percentiles,
    "bio_align": bio_align,
    "bio_metrics": bio_metrics,
    "bio_subwords": bio_subwords,
    "subword_merge": subword_merge,
    "tagger_scores": tagger_scores,
    "class_weights": class_weights,
    "argmax_tags": argmax_tags,
    "weighted_loss": weighted_loss,
    "best_epoch": best_epoch,
    "leak_scan_conversations": leak_scan,
    "synth_notes": synth_notes,
    "synth_label_support": synth_label_support,
}

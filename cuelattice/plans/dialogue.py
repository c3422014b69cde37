"""Queries on text, cues, translations and speakers, over conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes, text
from ..operators import alignment as al
from ..operators import cues as cu
from ..operators import measures as ms
from ..operators import speakers as sp
from ..operators import translation as tr
from .adapters import CUES, LINES, PAIRS, SPANS, cues, lines, pairs, spans, table

K = ["key"]

#: SQL of text.tokens() and others, for a column.
_NORM = "regexp_replace(lower({w}), '[^\\p{{L}}\\p{{N}}_'']', '', 'g')"


def _tokens(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '\\S+'), lambda w: {_NORM.format(w='w')}), lambda w: w <> '')"


def _letters(c: str) -> str:
    return f"len(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


_U = text.UNSPACED


def norm_tokens(spark, sf_dir):
    """Distinct and all tokens of each speaker of each conversation."""
    d = cues(spark, sf_dir).select("key", "speaker", F.explode(text.tokens(F.col("text"))).alias("token"))
    return d.groupBy("key", "speaker").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("different"))


def talk_ranking(spark, sf_dir):
    return sp.talk_ranking(cues(spark, sf_dir), K)


def gram_containment(spark, sf_dir):
    """Benchmark items of which a document holds three in five trigrams.

    Trigrams are 64-bit hashes. Those of items are counted before they are sent to the documents'; beyond the
    bound both sides are shuffled.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", text.gram_hashes(text.tokens(F.col("text")), 3).alias("g"))
    items = b.select("item_id", F.size("g").alias("total"), F.explode("g").alias("gram"))
    if items.count() * 24 <= 32 * 1024 * 1024:
        items = F.broadcast(items)
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.gram_hashes(text.tokens(F.col("text")), 3)).alias("gram"))
    hits = d.join(items, "gram").groupBy("doc_id", "item_id", "total").agg(F.count("*").alias("hits"))
    return hits.where(5 * F.col("hits") >= 3 * F.col("total")).select("doc_id", "item_id", "hits", F.col("total").cast("long").alias("total"))


def timecode(spark, sf_dir):
    ms_ = shapes.milliseconds(F.col("value") * 60)
    return table(spark, sf_dir, "events").select("event_id", shapes.srt_time(ms_).alias("srt"), shapes.ass_time(ms_).alias("ass"))


def unspaced_words(spark, sf_dir):
    """Words of a text with unspaced scripts: the items with a Thai and a Chinese phrase put behind them."""
    t = F.concat(F.col("text"), F.lit(" สวัสดีครับ 你好世界 end"))
    b = table(spark, sf_dir, "benchmark").withColumn("parts", text.split_words(t))
    return b.select("item_id", F.size("parts").cast("long").alias("words"), text.joined_words(F.col("parts")).alias("joined"))


def reading_time(spark, sf_dir):
    return cues(spark, sf_dir).select("key", "number", F.round(text.reading_seconds(F.col("text")), 6).alias("seconds"))


def char_budget(spark, sf_dir):
    d = cues(spark, sf_dir)
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    return d.select("key", "number", shapes.char_budget(seconds, 17.0).cast("long").alias("budget"), F.element_at(shapes.part_budgets(seconds, F.lit(2), 17.0), 1).cast("long").alias("part_budget"))


def digit_normalise(spark, sf_dir):
    t = F.concat(F.col("text"), F.lit("  ١٢٣ what?! yes!؟ ?؟ "))
    return cues(spark, sf_dir).select("key", "number", text.normalise(t).alias("text"))


def number_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.numbers(F.col("text"))).alias("number"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("number").alias("largest"))


def orthography_fold(spark, sf_dir):
    t = F.concat(F.lit("أَهْلًا إلى ۀ كتابة "), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.fold(t).alias("folded"), text.echo_fold(t).alias("echoed"))


def inert_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.inert(F.col("html"))).alias("inert"), F.length(text.plain(F.col("html"))).cast("long").alias("plain"))


def filler_only(spark, sf_dir):
    """Short turns, and drawn-out fillers put beside them."""
    d = cues(spark, sf_dir).withColumn("text", F.when(F.col("number") % 3 == 0, F.lit("Ummmm, haha!")).otherwise(F.col("text")))
    return d.select("key", "number", text.only_a_sound(F.col("text")).alias("sound"))


def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clipped(F.col("text"), 200).alias("head"))


def sentence_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark")
    return d.select("item_id", F.posexplode(text.sentence_chunks(F.col("text"), 60)).alias("k", "chunk"))


def marked_order(spark, sf_dir):
    t = F.when(F.col("number") % 2 == 0, F.concat(F.lit("[B] "), "text", F.lit(" || [A] x"))).otherwise(F.concat(F.lit("[A] y || [A] "), "text"))
    return cues(spark, sf_dir).select("key", "number", text.in_order(t).alias("text"))


def glossary_scan(spark, sf_dir):
    """Glossary lines made of regions, the odd ones for English: the name means the key."""
    tag = F.when(F.col("r_regionkey") % 2 == 1, "en: ").otherwise("zh-TW: ")
    t = table(spark, sf_dir, "region").select(F.array_join(F.sort_array(F.collect_list(F.concat(tag, "r_name", F.lit(" = key "), F.col("r_regionkey").cast("string")))), ";").alias("t"))
    return t.select(F.explode(text.glossary_entries(F.col("t"), "en")).alias("g")).select("g.*")


def label_class(spark, sf_dir):
    lab = F.concat(F.lit("p"), F.col("id") % 3, F.lit("."), F.col("label"), F.when(F.col("id") % 2 == 0, F.lit("~p2")).otherwise(F.lit("")))
    d = sp.labels(spans(spark, sf_dir).withColumn("heard", lab), "heard")
    return d.groupBy("speaker", "base", "linked").agg(F.count("*").alias("n"))


def qa_issues(spark, sf_dir):
    return cu.qa_issues(cues(spark, sf_dir), K)


def doubt_rollup(spark, sf_dir):
    d = ms.doubts(qa_issues(spark, sf_dir), K)
    return d.select("key", "kind", "n", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first"))


def readable_ends(spark, sf_dir):
    return cu.readable_ends(cues(spark, sf_dir), K, 17.0, 6000, 83).select("key", "number", "new_end_ms")


def srt_text(spark, sf_dir):
    return cu.srt_files(cues(spark, sf_dir), K).select("key", F.md5("srt").alias("srt"), F.length("srt").cast("long").alias("chars"))


def staged_blocks(spark, sf_dir):
    two = F.when(F.col("number") % 2 == 1, F.concat("text", F.lit("||"), F.reverse("text"))).otherwise(F.col("text"))
    return cu.stages(cues(spark, sf_dir).withColumn("text", two)).select("key", "number", "stage", "shown", "from_ms", "until_ms")


def ass_events(spark, sf_dir):
    d = cues(spark, sf_dir)
    return cu.ass_events(d, K, sp.talk_ranking(d, K).select("key", "speaker", "rank")).select("key", "number", F.md5("event").alias("event"))


def dub_lines(spark, sf_dir):
    d = cues(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" || "), F.reverse("text")))
    return cu.dub_lines(d, K, 600_000).select("key", "number", "part", "text", "until_ms")


def batching(spark, sf_dir):
    d = cu.batches(cues(spark, sf_dir), K, 60_000, 3)
    return d.groupBy("key", "batch").agg(F.min("number").alias("first"), F.count("*").alias("n"))


def balance_lines(spark, sf_dir):
    got = cu.balanced(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(got, "|").alias("lines"))


def best_split(spark, sf_dir):
    """Words 400 ms apart, 20 ms a letter."""
    start = lambda i: i.cast("long") * 400_000
    w = F.transform(text.words(F.col("text")), lambda x, i: F.struct(x.alias("text"), start(i).alias("s"), (start(i) + 20_000 * F.length(x)).alias("e")))
    return table(spark, sf_dir, "benchmark").select("item_id", cu.best_split(w).cast("long").alias("after"))


def thinned_lines(spark, sf_dir):
    return cu.thinned(lines(spark, sf_dir), K, 3, 2).select("key", "number")


def frame_order(spark, sf_dir):
    return cu.spread_order(cues(spark, sf_dir), K, "start_ms").select("key", "number", "turn")


def unfaithful_numbers(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumns({"source": F.concat("source", F.lit(" 1,234 and "), F.col("key") + 10), "target": F.concat("target", F.lit(" "), F.col("number") + 10)})
    return tr.lost_numbers(d).select("key", "number", F.array_join("lost", ",").alias("lost"))


def echoes(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumn("target", F.when(F.col("number") == 1, F.concat("source", F.lit(" !"))).otherwise(F.col("target")))
    return tr.echoes(d, K).select("key", "number")


def shortened(spark, sf_dir):
    return tr.shortened(pairs(spark, sf_dir), K).select("key", "number", F.round("ratio", 6).alias("ratio"), F.round("usual", 6).alias("usual"))


def slide_corr(spark, sf_dir):
    return tr.slide(pairs(spark, sf_dir), K, least=3)


def slide_windows(spark, sf_dir):
    """Over lines of documents: a line's translation is the next line."""
    d = lines(spark, sf_dir).select("key", "number", F.col("text").alias("source"), F.reverse("text").alias("target"))
    got = tr.slid_windows(d.withColumn("target", F.concat("target", F.repeat(F.lit("x"), (F.col("number") % 5).cast("int")))), K)
    return got.select("key", "window", "n", F.round("straight", 3).alias("straight"), F.round("shifted", 3).alias("shifted"))


def glossary_misnamed(spark, sf_dir):
    """Pairs that say "the", "and" or "of the" without the made-up meaning."""
    g = spark.sql("SELECT * FROM VALUES ('the', 'thth'), ('and', 'anan'), ('of the', 'ofof') AS g(term, meaning)")
    return tr.misnamed(pairs(spark, sf_dir), g).select("key", "number", "term")


def context_lines(spark, sf_dir):
    got = tr.context(pairs(spark, sf_dir), K)
    return got.select("key", "number", F.size("around").cast("long").alias("n"), F.md5(F.array_join("around", "\n")).alias("around"))


def slot_acceptance(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumns({"source": F.concat("source", F.lit("||b")), "target": F.when(F.col("number") % 2 == 0, F.concat("target", F.lit(" || c"))).otherwise(F.col("target"))})
    who = F.when(F.col("key") % 3 == 0, F.array(F.lit("A"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    return tr.accepted(d.withColumn("who", who), "who").select("key", "number", "accepted")


def translate_rounds(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumns({"first": F.when(F.col("number") % 3 == 0, F.col("target")), "second": F.when(F.col("number") % 3 == 1, F.reverse("target")).otherwise(F.lit(" "))})
    got = tr.rounds(d, ["first", "second"])
    return got.groupBy("key", "engine").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def cue_quality(spark, sf_dir):
    d = cues(spark, sf_dir)
    return ms.cue_quality(d.withColumn("end_ms", F.col("end_ms") + 40 * (F.col("number") % 2)), K)


def sane_pass(spark, sf_dir):
    """Lines of documents as a pass; a line takes 30 ms a character."""
    d = lines(spark, sf_dir).withColumn("seconds", F.length("text") * 0.03)
    return ms.sane_pass(d, K, F.col("seconds")).groupBy("key").agg(F.count("*").alias("lines"))


def majority_vote(spark, sf_dir):
    """The vote of three passes over a user's events: the event's id is the word, so that words are matched in one way only."""
    return al.vote(event_passes(spark, sf_dir), K).select("key", "line", "s", "e", "confirmed", "words")


def event_passes(spark, sf_dir):
    """Events as words of three passes; the later ones miss some, and whole lines of 50."""
    w = spans(spark, sf_dir).select("key", F.floor(F.col("id") / 50).alias("line"), F.col("id").alias("seq"), F.col("id").cast("string").alias("token"), "s", "e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pass"))
    return w.where("pass = 0 or (pass = 1 and seq % 7 <> 3 and line % 3 <> 1) or (pass = 2 and seq % 5 <> 2 and line % 4 <> 1)")


def pass_links(spark, sf_dir):
    """Labels of two passes of events that meet: the type of an event and of the next one of the user."""
    d = spans(spark, sf_dir)
    nxt = F.lead("label").over(Window.partitionBy("key").orderBy("s", "e", "id"))
    return sp.pass_links(d.select("key", F.col("label").alias("mine"), nxt.alias("theirs")).where("theirs is not null"), K, 3, 0.3)


def label_assignment(spark, sf_dir):
    d = spans(spark, sf_dir)
    nxt = F.lead("label").over(Window.partitionBy("key").orderBy("s", "e", "id"))
    got = sp.confusion_best(d.select("key", "label", nxt.alias("heard")).where("heard is not null"), K, "label", "heard")
    return got.groupBy("key").agg(F.sum("n").alias("agreed"))


QUERIES = {f.__name__: f for f in (norm_tokens, talk_ranking, gram_containment, timecode, unspaced_words, reading_time, char_budget, digit_normalise, number_extract, orthography_fold, inert_text, filler_only, clip_text, sentence_chunks, marked_order, glossary_scan, label_class, qa_issues, doubt_rollup, readable_ends, srt_text, staged_blocks, ass_events, dub_lines, batching, balance_lines, best_split, thinned_lines, frame_order, unfaithful_numbers, echoes, shortened, slide_corr, slide_windows, glossary_misnamed, context_lines, slot_acceptance, translate_rounds, cue_quality, sane_pass, majority_vote, pass_links, label_assignment)}

_COUNTED = f"len(regexp_extract_all(text, '[^\\s{_U}]+')) + len(regexp_extract_all(text, '[{_U}]')) * 0.25"
_ISSUES = f"""i AS (SELECT *, string_split(text, chr(10)) AS shown, lead(start_ms) OVER (PARTITION BY key ORDER BY number) AS nxt FROM cues),
  issues AS (SELECT key, number, 'untranslated' AS kind FROM i WHERE trim(text) = ''
    UNION ALL SELECT key, number, 'line_length' FROM i WHERE len(list_filter(shown, lambda x: len(x) > 42)) > 0
    UNION ALL SELECT key, number, 'too_many_lines' FROM i WHERE len(shown) > 2
    UNION ALL SELECT key, number, 'reading_speed' FROM i WHERE len(text) > (end_ms - start_ms) / 1000 * 17.0 * 1.25
    UNION ALL SELECT key, number, 'too_short' FROM i WHERE end_ms - start_ms < 900
    UNION ALL SELECT key, number, 'overlap' FROM i WHERE end_ms > nxt - 83)"""
_RANKS = f"""n AS (SELECT key, speaker, CAST(sum(len({_tokens('text')})) AS BIGINT) AS words, min(number) AS f FROM cues GROUP BY key, speaker),
  ranks AS (SELECT key, speaker, words, row_number() OVER (PARTITION BY key ORDER BY words DESC, f, speaker) - 1 AS rank FROM n)"""


def _srt(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _ass(ms: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000 // 10)"


def _plain(c: str) -> str:
    return f"translate(regexp_replace({c}, '<[^<>]*>', '', 'g'), '{{}}', '()')"


def _numbers(c: str) -> str:
    # thousands: digits, a comma and exactly three digits; RE2 looks no further, so the end is kept and put back
    digits = f"translate({c}, '{text.EASTERN}', '{text.WESTERN}')"
    joined = f"regexp_replace({digits}, '(\\d)[,٬](\\d\\d\\d)(\\D|$)', '\\1\\2\\3', 'g')"
    return f"list_filter(regexp_extract_all({joined}, '\\d\\d+'), lambda n: NOT suffix(n, '00'))"


def _corr(x: str, y: str) -> str:
    both = f"FILTER ({y} IS NOT NULL)"
    return f"round(CASE WHEN stddev_pop({x}) {both} > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) {both} * stddev_pop({y})) ELSE 0 END, {{d}})"


SQL = {
    "norm_tokens": f"WITH {CUES}, t AS (SELECT key, speaker, unnest({_tokens('text')}) AS token FROM cues) SELECT key, speaker, count(*) AS tokens, count(DISTINCT token) AS different FROM t GROUP BY key, speaker",
    "talk_ranking": f"WITH {CUES}, {_RANKS} SELECT key, speaker, words, rank FROM ranks",
    "gram_containment": f"""WITH b AS (SELECT item_id, {_tokens('text')} AS t FROM benchmark), bg AS (SELECT DISTINCT item_id, array_to_string(t[i:i+2], ' ') AS gram FROM b, range(1, len(t) - 1) r(i)),
  d AS (SELECT doc_id, {_tokens('text')} AS t FROM documents), dg AS (SELECT DISTINCT doc_id, array_to_string(t[i:i+2], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM d)),
  n AS (SELECT item_id, count(*) AS total FROM bg GROUP BY item_id)
  SELECT doc_id, item_id, count(*) AS hits, any_value(total) AS total FROM dg JOIN bg USING (gram) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 5 * count(*) >= 3 * any_value(total)""",
    "timecode": f"WITH m AS (SELECT event_id, greatest(CAST(round_even(value * 60 * 1000, 0) AS BIGINT), 0) AS ms FROM events) SELECT event_id, {_srt('ms')} AS srt, {_ass('ms')} AS ass FROM m",
    "reading_time": f"WITH {CUES} SELECT key, number, round(CAST({_COUNTED} AS DOUBLE) / 5.0, 6) AS seconds FROM cues",
    "char_budget": f"WITH {CUES}, b AS (SELECT key, number, greatest(12, least(84, CAST(floor((end_ms - start_ms) / 1000 * 17.0) AS BIGINT))) AS budget FROM cues) SELECT key, number, budget, least(greatest(12, budget // 2), 40) AS part_budget FROM b",
    "digit_normalise": f"WITH {CUES} SELECT key, number, trim(regexp_replace(replace(replace(replace(translate(text || '  ١٢٣ what?! yes!؟ ?؟ ', '{text.EASTERN}', '{text.WESTERN}'), '؟!', '؟'), '!؟', '؟'), '?!', '؟'), '\\s+', ' ', 'g')) AS text FROM cues",
    "number_extract": f"WITH n AS (SELECT doc_id, unnest({_numbers('text')}) AS number FROM documents) SELECT doc_id, count(*) AS n, max(number) AS largest FROM n GROUP BY doc_id",
    "orthography_fold": f"WITH b AS (SELECT item_id, 'أَهْلًا إلى ۀ كتابة ' || text AS t FROM benchmark) SELECT item_id, translate(translate(t, '{text.MARKS}', ''), '{text.SHAPES_FROM}', '{text.SHAPES_TO}') AS folded, translate(t, '{text.ECHO_FROM}', '{text.ECHO_TO}') AS echoed FROM b",
    "inert_text": f"SELECT page_id, md5(translate(html, '<>', '‹›')) AS inert, len({_plain('html')}) AS plain FROM pages",
    "clip_text": "SELECT doc_id, CASE WHEN len(text) <= 200 THEN text ELSE regexp_replace(left(text, 200), '\\s+\\S*\\z', '') END AS head FROM documents",
    "qa_issues": f"WITH {CUES}, {_ISSUES} SELECT * FROM issues",
    "doubt_rollup": f"WITH {CUES}, {_ISSUES} SELECT key, kind, count(*) AS n, array_to_string(list_sort(list(DISTINCT number))[1:6], ',') AS first FROM issues GROUP BY key, kind",
    "readable_ends": f"""WITH {CUES}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY key ORDER BY number) AS nxt FROM cues)
  SELECT key, number, CAST(greatest(end_ms, least(start_ms + CAST(ceil(len(text) * 1000 / 17.0) AS BIGINT) + 1, end_ms + 2000, start_ms + 6000, coalesce(nxt - 83, 9e15::BIGINT))) AS BIGINT) AS new_end_ms FROM n""",
    "srt_text": f"""WITH {CUES}, b AS (SELECT key, number, row_number() OVER (PARTITION BY key ORDER BY number) AS block, string_split(text, '||') AS parts, start_ms, end_ms FROM cues WHERE trim(text) <> ''),
  f AS (SELECT key, string_agg(block || chr(10) || {_srt('start_ms')} || ' --> ' || {_srt('end_ms')} || chr(10) || {_plain('trim(parts[1])')} || chr(10), chr(10) ORDER BY block) AS srt FROM b GROUP BY key)
  SELECT key, md5(srt) AS srt, len(srt) AS chars FROM f""",
    "staged_blocks": f"""WITH {CUES}, t AS (SELECT *, CASE WHEN number % 2 = 1 THEN text || '||' || reverse(text) ELSE text END AS body, CAST((start_ms + end_ms) / 2 AS BIGINT) AS h0, (start_ms + end_ms) // 2 AS half FROM cues),
  p AS (SELECT *, list_transform(string_split(body, '||'), lambda x: trim(x)) AS parts FROM t),
  q AS (SELECT *, len(parts) = 2 AND half / 1000 BETWEEN start_ms / 1000 + 0.4 AND end_ms / 1000 - 0.4 AS two FROM p)
  SELECT key, number, CAST(0 AS INTEGER) AS stage, CASE WHEN two THEN '- ' || parts[1] WHEN len(parts) > 1 THEN '- ' || parts[1] || chr(10) || '- ' || parts[2] ELSE parts[1] END AS shown, start_ms AS from_ms, CASE WHEN two THEN half ELSE end_ms END AS until_ms FROM q
  UNION ALL SELECT key, number, 1, '- ' || parts[1] || chr(10) || '- ' || parts[2], half, end_ms FROM q WHERE two""",
    "ass_events": f"""WITH {CUES}, {_RANKS}, c AS (SELECT c.*, r.rank, least(200, (end_ms - start_ms) // 4) AS fade,
    ['#f7f5f0','#ffe066','#8fe3f5','#a8e6a1'][CASE WHEN r.rank = 0 THEN 1 ELSE (r.rank - 1) % 3 + 2 END] AS colour FROM cues c JOIN ranks r USING (key, speaker))
  SELECT key, number, md5('Dialogue: 0,' || {_ass('start_ms')} || ',' || {_ass('end_ms')} || ',Default,,0,0,0,,' || '{{\\fad(' || fade || ',' || fade || ')\\c' || upper('&H00' || colour[6:7] || colour[4:5] || colour[2:3]) || '&}}' || replace({_plain('text')}, chr(10), '\\N')) AS event FROM c""",
    "dub_lines": f"""WITH {CUES}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY key ORDER BY number) AS nxt FROM cues),
  u AS (SELECT key, number, [trim(text), trim(reverse(text))] AS parts, CASE WHEN nxt IS NULL THEN least(600000, start_ms + 30000) ELSE greatest(nxt, start_ms + 500) END AS until_ms FROM n)
  SELECT key, number, CAST(k - 1 AS INTEGER) AS part, parts[k] AS text, until_ms FROM u, (VALUES (1), (2)) v(k)""",
    "balance_lines": """WITH w AS (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark), j AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w),
  c AS (SELECT item_id, w, i, array_to_string(w[:i], ' ') AS a, array_to_string(w[i+1:], ' ') AS b FROM j),
  s AS (SELECT *, abs(len(a) - len(b)) - CASE WHEN regexp_matches(w[i], '[.!?…。！？؟,;:،؛、，；：]["''”’)\\]]*$') THEN 12 ELSE 0 END + CASE WHEN len(a) > 42 THEN 1000 ELSE 0 END + CASE WHEN len(b) > 42 THEN 1000 ELSE 0 END AS cost FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cost, i) AS k FROM s)
  SELECT w.item_id, CASE WHEN len(array_to_string(w.w, ' ')) <= 42 OR len(w.w) < 2 THEN array_to_string(w.w, ' ') ELSE k.a || '|' || k.b END AS lines FROM w LEFT JOIN k ON k.item_id = w.item_id AND k.k = 1""",
    "best_split": """WITH w AS (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark), c AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w),
  s AS (SELECT item_id, i, round(CASE WHEN regexp_matches(w[i], '[.!?…。！？؟]["''”’)\\]]*$') THEN 2.0 WHEN regexp_matches(w[i], '[,;:،؛、，；：]["''”’)\\]]*$') THEN 1.0 ELSE 0.0 END
    + 2 * CAST(400000 - 20000 * len(w[i]) AS DOUBLE) / 1e6 - CAST(abs((i - 1) * 400000 + 20000 * len(w[i]) + i * 400000 - (len(w) - 1) * 400000 - 20000 * len(w[len(w)])) AS DOUBLE) / 2 / greatest((len(w) - 1) * 400000 + 20000 * len(w[len(w)]), 1), 9) AS score FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) AS k FROM s)
  SELECT b.item_id, k.i AS after FROM benchmark b LEFT JOIN k ON k.item_id = b.item_id AND k.k = 1""",
    "thinned_lines": f"WITH {LINES}, g AS (SELECT key, number, (row_number() OVER (PARTITION BY key ORDER BY number) - 1) // 3 AS g, ceil(count(*) OVER (PARTITION BY key) / 3) AS n FROM lines) SELECT key, number FROM g WHERE g % greatest(1, ceil(n / 2)) = 0",
    "frame_order": f"WITH {CUES}, i AS (SELECT key, number, row_number() OVER (PARTITION BY key ORDER BY start_ms) - 1 AS i FROM cues) SELECT key, number, row_number() OVER (PARTITION BY key ORDER BY i % 4, i) AS turn FROM i",
    "unfaithful_numbers": f"""WITH {PAIRS}, p AS (SELECT key, number, source || ' 1,234 and ' || (key + 10) AS source, target || ' ' || (number + 10) AS target FROM pairs),
  n AS (SELECT key, number, {_numbers('source')} AS a, {_numbers('target')} AS b FROM p), l AS (SELECT key, number, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS lost FROM n)
  SELECT key, number, array_to_string(lost, ',') AS lost FROM l WHERE len(lost) > 0""",
    "echoes": f"""WITH {PAIRS}, p AS (SELECT key, number, source, CASE WHEN number = 1 THEN source || ' !' ELSE target END AS target FROM pairs),
  e AS (SELECT key, number, len({_tokens('source')}) >= 3 AS lng, len({_tokens('source')}) >= 3 AND {_tokens('source')} = {_tokens('target')} AS echo FROM p),
  s AS (SELECT *, count(*) FILTER (echo) OVER (PARTITION BY key) / greatest(count(*) FILTER (lng) OVER (PARTITION BY key), 1) AS part FROM e) SELECT key, number FROM s WHERE echo AND part < 0.5""",
    "shortened": f"""WITH {PAIRS}, r AS (SELECT key, number, {_letters('target')} / greatest({_letters('source')}, 1) AS ratio FROM pairs WHERE len({_tokens('source')}) >= 6 AND {_tokens('source')} <> {_tokens('target')}),
  u AS (SELECT key, median(ratio) AS usual FROM r GROUP BY key HAVING count(*) >= 5) SELECT key, number, round(ratio, 6) AS ratio, round(usual, 6) AS usual FROM r JOIN u USING (key) WHERE ratio < 0.4 * usual""",
    "slide_corr": f"""WITH {PAIRS}, l AS (SELECT key, CAST(len(source) AS DOUBLE) AS a, CAST(len(target) AS DOUBLE) AS b, lead(CAST(len(target) AS DOUBLE)) OVER (PARTITION BY key ORDER BY number) AS c FROM pairs),
  k AS (SELECT key, count(*) AS n, {_corr('a', 'b').format(d=4)} AS straight, {_corr('a', 'c').format(d=4)} AS shifted FROM l GROUP BY key HAVING count(*) >= 3)
  SELECT *, straight < 0.3 AND shifted - straight > 0.25 AS slid FROM k""",
    "glossary_misnamed": f"""WITH {PAIRS}, g(term, meaning) AS (VALUES ('the', 'thth'), ('and', 'anan'), ('of the', 'ofof')), s AS (SELECT key, number, target, ' ' || array_to_string({_tokens('source')}, ' ') || ' ' AS said FROM pairs)
  SELECT key, number, term FROM s, g WHERE contains(said, ' ' || term || ' ') AND NOT contains(lower(target), meaning)""",
    "context_lines": f"""WITH {PAIRS}, c AS (SELECT key, number, list(source) OVER (PARTITION BY key ORDER BY number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, list(source) OVER (PARTITION BY key ORDER BY number ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM pairs),
  m AS (SELECT key, number, list_concat(coalesce(b, []), coalesce(a, [])) AS x FROM c) SELECT key, number, len(x) AS n, md5(coalesce(array_to_string(x, chr(10)), '')) AS around FROM m""",
    "translate_rounds": f"""WITH {PAIRS}, r AS (SELECT key, CASE WHEN number % 3 = 0 AND trim(target) <> '' THEN 'first' WHEN number % 3 = 1 AND trim(target) <> '' THEN 'second' ELSE 'source' END AS engine, source, target FROM pairs)
  SELECT key, engine, count(*) AS n, CAST(sum(CASE WHEN engine = 'source' THEN len(source) ELSE len(target) END) AS BIGINT) AS chars FROM r GROUP BY key, engine""",
    "cue_quality": f"""WITH {CUES}, d AS (SELECT key, number, len({_tokens('text')}) AS n, array_to_string({_tokens('text')}, ' ') AS t, start_ms, end_ms + 40 * (number % 2) AS end_ms FROM cues),
  w AS (SELECT key, n, n > 5.5 * greatest((end_ms - start_ms) / 1000, 0.4) AS rushed, (end_ms - start_ms) / 1000 < 0.9 AS short, coalesce(lead(start_ms) OVER v < end_ms, false) AS ov, coalesce(lag(t) OVER v = t, false) AND n > 0 AS dbl FROM d WINDOW v AS (PARTITION BY key ORDER BY number))
  SELECT key, count(*) AS cues, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (rushed) AS rushed, count(*) FILTER (short) AS short, count(*) FILTER (ov) AS overlapping, count(*) FILTER (dbl) AS doubled FROM w GROUP BY key""",
    "sane_pass": f"""WITH {LINES}, c AS (SELECT key, {_COUNTED} AS n, len(text) * 0.03 AS s FROM lines), o AS (SELECT key, n, s <= 60 AND (n < 10 OR n <= 8 * greatest(s, 0.1)) AS ok FROM c),
  h AS (SELECT *, sum(CASE WHEN ok THEN n ELSE 0 END) OVER (PARTITION BY key) / greatest(sum(n) OVER (PARTITION BY key), 1e-9) AS share FROM o) SELECT key, count(*) AS lines FROM h WHERE ok AND share >= 0.9 GROUP BY key""",
    "majority_vote": f"""WITH {SPANS}, w AS (SELECT key, id // 50 AS line, id, s, e, CASE WHEN id % 7 <> 3 AND (id // 50) % 3 <> 1 THEN 1 ELSE 0 END AS p1, CASE WHEN id % 5 <> 2 AND (id // 50) % 4 <> 1 THEN 1 ELSE 0 END AS p2 FROM spans),
  n AS (SELECT key, 1 + max(p1) + max(p2) AS passes FROM w GROUP BY key), b AS (SELECT key, line, min(s) AS s, max(e) AS e FROM w GROUP BY ALL),
  o AS (SELECT key, line, 1 AS p, min(s) AS s, max(e) AS e FROM w WHERE p1 = 1 GROUP BY ALL UNION ALL SELECT key, line, 2, min(s), max(e) FROM w WHERE p2 = 1 GROUP BY ALL),
  m AS (SELECT w.key, w.line, w.id, o.p, o.s, o.e, b.s AS bs, b.e AS be FROM w JOIN o ON o.key = w.key AND o.line = w.line AND ((o.p = 1 AND p1 = 1) OR (o.p = 2 AND p2 = 1)) JOIN b ON b.key = w.key AND b.line = w.line WHERE b.s < o.e + 2000000 AND o.s < b.e + 2000000),
  v AS (SELECT w.key, w.line, w.id, 1 + count(DISTINCT m.p) AS votes FROM w LEFT JOIN m USING (key, line, id) GROUP BY ALL),
  k AS (SELECT v.key, v.line, count(*) FILTER (votes >= passes // 2 + 1) AS confirmed, count(*) AS words FROM v JOIN n USING (key) GROUP BY ALL),
  t AS (SELECT key, line, s, e FROM b UNION ALL SELECT key, line, s, e FROM m WHERE abs(e - s - (be - bs)) <= greatest(1000000, be - bs)),
  d AS (SELECT key, line, CAST(trunc(median(s)) AS BIGINT) AS s, CAST(trunc(median(e)) AS BIGINT) AS e FROM t GROUP BY ALL)
  SELECT key, line, s, greatest(s, e) AS e, confirmed, words FROM k JOIN d USING (key, line) WHERE confirmed >= 1 AND 3 * confirmed >= words""",
    "pass_links": f"""WITH {SPANS}, p AS (SELECT * FROM (SELECT key, label AS mine, lead(label) OVER (PARTITION BY key ORDER BY s, e, id) AS theirs FROM spans) WHERE theirs IS NOT NULL),
  n AS (SELECT key, mine, theirs, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY key, theirs) AS total FROM n),
  k AS (SELECT *, row_number() OVER (PARTITION BY key, theirs ORDER BY n DESC, mine) AS k FROM a WHERE n >= 3 AND n >= 0.3 * total) SELECT key, mine, theirs, n FROM k WHERE k = 1""",
}
SQL["label_class"] = f"""WITH {SPANS}, h AS (SELECT label AS base, label || CASE WHEN id % 2 = 0 THEN '~p2' ELSE '' END AS speaker FROM spans)
  SELECT speaker, base, NOT regexp_matches(speaker, '(~[pkxr]\\d+)+$') AS linked, count(*) AS n FROM h GROUP BY ALL"""
SQL["glossary_scan"] = "SELECT 'en' AS language, r_name AS term, 'key ' || r_regionkey AS meaning FROM region WHERE r_regionkey % 2 = 1"
SQL["slot_acceptance"] = f"""WITH {PAIRS}, p AS (SELECT key, number, source AS s1, CASE WHEN number % 2 = 0 THEN [trim(target), 'c'] ELSE [trim(target)] END AS parts FROM pairs)
  SELECT key, number, CASE WHEN key % 3 = 0 THEN array_to_string(list_filter(parts, lambda x: x <> ''), ' ')
    WHEN len(parts) = 2 AND NOT (trim(s1) <> '' AND parts[1] = '') THEN parts[1] || ' || ' || parts[2] ELSE '' END AS accepted FROM p"""
SQL["marked_order"] = f"""WITH {CUES} SELECT key, number, CASE WHEN number % 2 = 0 THEN '[A] x || ' || trim('[B] ' || text) ELSE '[A] y || [A] ' || text END AS text FROM cues"""


def _once(w: str) -> str:
    return f"array_to_string(list_filter(string_split({w}, ''), lambda c, i: i = 1 OR c <> string_split({w}, '')[i - 1]), '')"


def _sound(w: str) -> str:
    return f"({w} IN ({', '.join(repr(f) for f in text.FILLERS)}) OR regexp_matches({w}, '{text.LAUGHTER}'))"


SQL["filler_only"] = f"""WITH {CUES}, t AS (SELECT key, number, CASE WHEN number % 3 = 0 THEN 'Ummmm, haha!' ELSE text END AS text FROM cues),
  p AS (SELECT key, number, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS parts FROM t),
  o AS (SELECT key, number, {_once("array_to_string(parts, '')")} AS whole, list_transform(parts, lambda x: {_once('x')}) AS each FROM p)
  SELECT key, number, len(each) > 0 AND ({_sound('whole')} OR len(list_filter(each, lambda x: NOT {_sound('x')})) = 0) AS sound FROM o"""
_SPLIT = f"[{_U}][\\p{{M}}\\x{{0E31}}\\x{{0E34}}-\\x{{0E3A}}\\x{{0E47}}-\\x{{0E4E}}]*|[^\\s{_U}]+"
SQL["unspaced_words"] = f"""WITH p AS (SELECT item_id, regexp_extract_all(text || ' สวัสดีครับ 你好世界 end', '{_SPLIT}') AS parts FROM benchmark)
  SELECT item_id, len(parts) AS words, list_reduce(parts, lambda s, x: s || CASE WHEN regexp_matches(s, '[{_U}]\\p{{M}}*$') AND regexp_matches(x, '^[{_U}]') THEN '' ELSE ' ' END || x) AS joined FROM p"""
_BEST = f"""WITH RECURSIVE {SPANS}, p AS (SELECT * FROM (SELECT key, label AS t, lead(label) OVER (PARTITION BY key ORDER BY s, e, id) AS h FROM spans) WHERE h IS NOT NULL),
  c AS (SELECT key, t, h, count(*) AS n FROM p GROUP BY ALL), ts AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS k FROM (SELECT DISTINCT key, t FROM c)),
  r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(0 AS BIGINT) AS total FROM c
    UNION SELECT r.key, ts.k, CASE WHEN c.h IS NULL THEN used ELSE list_sort(list_append(used, c.h)) END, total + coalesce(c.n, 0)
      FROM r JOIN ts ON ts.key = r.key AND ts.k = r.k + 1 JOIN (SELECT key, t, h, n FROM c UNION ALL SELECT DISTINCT key, t, NULL, 0 FROM c) c ON c.key = r.key AND c.t = ts.t AND (c.h IS NULL OR NOT list_contains(used, c.h)))
  SELECT key, max(total) AS agreed FROM r GROUP BY key"""
SQL["label_assignment"] = _BEST
SQL["batching"] = f"""WITH RECURSIVE {CUES}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY number) AS k FROM cues),
  b AS (SELECT key, k, number, start_ms AS since, 1 AS n, 1 AS batch FROM o WHERE k = 1
    UNION ALL SELECT o.key, o.k, o.number, CASE WHEN o.start_ms - since >= 60000 OR n >= 3 THEN o.start_ms ELSE since END, CASE WHEN o.start_ms - since >= 60000 OR n >= 3 THEN 1 ELSE n + 1 END, CASE WHEN o.start_ms - since >= 60000 OR n >= 3 THEN batch + 1 ELSE batch END FROM b JOIN o ON o.key = b.key AND o.k = b.k + 1)
  SELECT key, batch, min(number) AS first, count(*) AS n FROM b GROUP BY key, batch"""
SQL["sentence_chunks"] = """WITH RECURSIVE s AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark),
  c AS (SELECT item_id, l, 1 AS i, 0 AS k, l[1] AS chunk FROM s WHERE len(l) > 0
    UNION ALL SELECT item_id, l, i + 1, CASE WHEN len(chunk) + 1 + len(l[i + 1]) <= 60 THEN k ELSE k + 1 END, CASE WHEN len(chunk) + 1 + len(l[i + 1]) <= 60 THEN chunk || ' ' || l[i + 1] ELSE l[i + 1] END FROM c WHERE i < len(l))
  SELECT item_id, CAST(k AS INTEGER) AS k, max_by(chunk, i) AS chunk FROM c GROUP BY item_id, k"""
SQL["slide_windows"] = f"""WITH {LINES}, l AS (SELECT key, CAST(len(text) AS DOUBLE) AS a, CAST(len(text) + number % 5 AS DOUBLE) AS b, row_number() OVER (PARTITION BY key ORDER BY number) - 1 AS i, number FROM lines),
  w AS (SELECT key, a, b, number, unnest(range(CAST(greatest(0, floor((i - 12) / 6) + 1) AS BIGINT), i // 6 + 1)) AS win FROM l),
  c AS (SELECT key, win, a, b, lead(b) OVER (PARTITION BY key, win ORDER BY number) AS c FROM w)
  SELECT key, CAST(win AS INTEGER) AS "window", count(*) AS n, round({_corr('a', 'b').format(d=4)}, 3) AS straight, round({_corr('a', 'c').format(d=4)}, 3) AS shifted FROM c GROUP BY key, win HAVING count(*) >= 8"""

"""Queries on edits, guards, rewrites and source analysis.

Donor exemplars are pairs of a text before and after, and their edits are derived
from them. Chunks get known defects by a template of snippets (operators/defects),
so that rules, patterns and guards have something to find in every table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, code, defects, edits, proposals, rewrite
from ..sources.tables import latest, latest_texts, table
from . import sql as S

FILE, PAD, WINDOW, SHARED = "buggy.py", 3, 8, 2
#: Prompt variants: which sections each has; the budget in tokens; most lines of code.
VARIANTS = {"full": ("task", "code", "example", "rules"), "bare": ("code",), "plain": ("task", "code"), "guided": ("task", "code", "rules")}
BUDGET, CODE_LINES = 400, 220
TASK, RULES = "Repair the program. Answer with edits of line ranges.", "Keep names and interfaces. Touch only the lines shown."


def _donors(spark: SparkSession, d: str) -> DataFrame:
    """Donors with both texts, their lines a and b, the ends these share, and two edits: the lines between become those after, and the first line is put in again."""
    both = latest_texts(table(spark, d, "donor_exemplars"), ["donor_id"], ["case_id", "buggy_chunk", "fixed_chunk"]).where("length(buggy_chunk) > 0 and length(fixed_chunk) > 0")
    lined = both.withColumn("a", T.split_lines(F.col("buggy_chunk"))).withColumn("b", T.split_lines(F.col("fixed_chunk"))).withColumn("ends", edits.common_ends(F.col("a"), F.col("b")))
    last = F.size("a") - F.col("ends.tail")
    made = lambda start, end, text: F.struct(F.lit(FILE).alias("file"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("replacement"))
    middle = T.line_range(F.col("b"), F.col("ends.head") + 1, F.size("b") - F.col("ends.tail"))
    again = made(F.lit(1), F.lit(1), F.coalesce(F.get("a", F.lit(0)), F.lit("")))
    return lined.withColumn("edits", F.array(made(F.col("ends.head") + 1, last, middle), again))


def _defective(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the template's defects: chunk_id, before, after, injected."""
    chunks = latest_texts(table(spark, d, "code_chunks"), ["chunk_id"], ["text"])
    return defects.defective(chunks, "chunk_id", "text").select("chunk_id", "before", "after", "injected")


def q_identifier_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Share of identifiers in common before and after."""
    return _donors(spark, d).select("donor_id", F.round(T.jaccard(T.tokens(F.col("buggy_chunk")), T.tokens(F.col("fixed_chunk"))), 6).alias("jaccard"))


def q_apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """The edited text, whether it is the text after, and whether the edits touch a line both."""
    patched = edits.apply_edits(F.col("buggy_chunk"), F.col("edits"))
    return _donors(spark, d).select("donor_id", F.md5(patched).alias("patched_md5"), (patched == F.array_join("b", "\n")).alias("restored"), edits.has_overlap(F.col("edits")).alias("overlap"))


def q_edit_size(spark: SparkSession, d: str) -> DataFrame:
    return _donors(spark, d).select("donor_id", edits.lines_touched(F.col("edits")).alias("touched"), edits.size_change(F.col("edits")).alias("change"))


def _region() -> Column:
    """The first three quarters of the lines, without the first line for every other donor."""
    return F.array(F.struct((F.col("donor_id") % 2 + 1).cast("int").alias("lo"), F.floor(F.size("a") * 3 / 4).cast("int").alias("hi")))


def q_region_filter(spark: SparkSession, d: str) -> DataFrame:
    """Edits inside the region of the text's lines."""
    kept = edits.in_region(F.col("edits"), _region())
    return _donors(spark, d).select("donor_id", F.size(kept).alias("kept"), (F.size(kept) == 0).alias("no_op"))


def q_lines_prf1(spark: SparkSession, d: str) -> DataFrame:
    """Lines changed by the edits inside the region against lines changed in the exemplar, each between the ends that the texts share. The measure by sequence comparison is q_touched_prf1."""
    kept = edits.apply_edits(F.col("buggy_chunk"), edits.in_region(F.col("edits"), _region()))
    lined = _donors(spark, d).withColumn("c", T.split_lines(kept)).withColumn("gold", edits.changed_lines(F.col("a"), F.col("b"), F.col("ends")))
    sets = lined.withColumn("made", edits.common_ends(F.col("a"), F.col("c"))).withColumn("pred", edits.changed_lines(F.col("a"), F.col("c"), F.col("made")))
    return sets.select("donor_id", edits.prf1(F.col("gold"), F.col("pred")).alias("x")).select("donor_id", "x.*")


def q_touched_prf1(spark: SparkSession, d: str) -> DataFrame:
    """Lines-P/R/F1 by sequence comparison: lines that the edits inside the region touch against lines that the exemplar touches."""
    donors = _donors(spark, d).withColumn("patched", edits.apply_edits(F.col("buggy_chunk"), edits.in_region(F.col("edits"), _region())))
    sets = code.touched_sets(donors, ["donor_id"], "buggy_chunk", "fixed_chunk", "patched")
    return sets.select("donor_id", edits.prf1(F.col("gold"), F.col("pred")).alias("x")).select("donor_id", "x.*")


def q_regex_guards(spark: SparkSession, d: str) -> DataFrame:
    """Register mix-ups and quantum registers of every chunk with defects."""
    return _defective(spark, d).select("chunk_id", edits.register_mix(F.col("before")).alias("mix"), F.size(edits.registers(F.col("before"), "Quantum")).alias("quantum_registers"))


def q_order_guard(spark: SparkSession, d: str) -> DataFrame:
    """Does the text after turn the order of two qubits?"""
    ranges = F.array(F.struct(F.lit(1).alias("lo"), F.lit(1_000_000).alias("hi")))
    return _defective(spark, d).select("chunk_id", edits.order_flip(F.col("before"), F.col("after"), ranges).alias("flipped"))


def q_rule_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with defects after the rewrite rules, and which of them changed it."""
    return rewrite.rewritten(_defective(spark, d), "before").select("chunk_id", F.md5("patched").alias("patched_md5"), F.array_join("rules", ",").alias("rules"))


def q_rule_lines(spark: SparkSession, d: str) -> DataFrame:
    """Where each rule was applied: line, before and after."""
    return rewrite.applied_lines(rewrite.rewritten(_defective(spark, d), "before", trace=True), ["chunk_id"])


def q_safe_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """The rewrites with a roll-back of what can't be parsed any more."""
    out = rewrite.rolled_back(rewrite.rewritten(_defective(spark, d), "before"), ["chunk_id"], "before")
    return out.select("chunk_id", "kept", F.md5("patched").alias("patched_md5"), F.array_join("rules", ",").alias("rules"))


def q_pattern_lines(spark: SparkSession, d: str) -> DataFrame:
    """Defect patterns by line, over all documents and all chunks with defects."""
    chunks = _defective(spark, d).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.col("before").alias("text"))
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    each = chunks.union(docs).where("text is not null").select("kind", "id", F.explode(rewrite.defect_lines(F.col("text"))).alias("x"))
    return each.select("kind", "id", "x.defect", "x.line")


def q_input_flags(spark: SparkSession, d: str) -> DataFrame:
    """The six flags of every chunk with defects, and how it fares in the audit of its pair."""
    return _defective(spark, d).select("chunk_id", *rewrite.input_flags(F.col("before")), rewrite.audit(F.col("before"), F.col("after")).alias("audited"))


def q_leak_free_pool(spark: SparkSession, d: str) -> DataFrame:
    """Donors that may serve a case: its own always, others only from training cases; how many each split sees."""
    cases = latest(table(spark, d, "all_cases"), ["case_id"], ["split"])
    train = cases.where("lower(trim(split)) like 'tr%'").select("case_id")
    donors = latest_texts(table(spark, d, "donor_exemplars"), ["donor_id"], ["case_id"])
    usable = donors.join(train, "case_id", "left_semi").agg(F.count("*").alias("shared"))
    own = donors.groupBy("case_id").agg(F.count("*").alias("own"))
    in_train = train.withColumn("in_train", F.lit(True))
    joined = cases.select("case_id").join(own, "case_id", "left").join(in_train, "case_id", "left").crossJoin(F.broadcast(usable))
    mine = F.coalesce("own", F.lit(0))
    return joined.select("case_id", mine.alias("own"), (F.col("shared") + F.when(F.col("in_train"), 0).otherwise(mine)).alias("usable"))


def q_leak_free_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of training donors' texts that may serve other cases: those that touch none of the donor's own changed lines."""
    train = latest(table(spark, d, "all_cases"), ["case_id"], ["split"]).where("lower(trim(split)) like 'tr%'").select("case_id")
    donors = _donors(spark, d).join(train, "case_id", "left_semi")
    gold = donors.select("donor_id", F.explode(edits.changed_lines(F.col("a"), F.col("b"), F.col("ends"))).alias("line"))
    cut = chunking.window_chunks(donors, F.col("case_id"), F.col("donor_id").cast("string"), F.col("buggy_chunk"), WINDOW, SHARED).select("donor_id", "start_line", "end_line")
    touches = (cut["donor_id"] == gold["donor_id"]) & gold["line"].between(cut["start_line"], cut["end_line"])
    return cut.join(gold, touches, "left_anti")


def q_exemplar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same lines of a donor's two texts: those it changes, with three lines around."""
    x = _donors(spark, d)
    lo = F.greatest(F.col("ends.head") + 1 - PAD, F.lit(1))
    hi = F.least(F.greatest(F.size("a") - F.col("ends.tail"), F.col("ends.head") + 1) + PAD, F.size("a"))
    return x.select("donor_id", lo.alias("lo"), hi.alias("hi"), F.md5(T.line_range(F.col("a"), lo, hi)).alias("buggy_md5"), F.md5(T.line_range(F.col("b"), lo, hi)).alias("fixed_md5"))


def q_diff(spark: SparkSession, d: str) -> DataFrame:
    """Syntax, interface drift and changed lines between a donor's texts, by sequence comparison."""
    return code.compared(_donors(spark, d), ["donor_id"], "buggy_chunk", "fixed_chunk")


def q_unified_diff(spark: SparkSession, d: str) -> DataFrame:
    """A donor's texts as a diff, by sequence comparison."""
    return code.diffs(_donors(spark, d), ["donor_id"], "buggy_chunk", "fixed_chunk")


def q_analyzer(spark: SparkSession, d: str) -> DataFrame:
    """Static findings of every chunk's template with defects, one row each; texts without any have one without a rule."""
    out = code.analysed(_defective(spark, d), ["chunk_id"], "before")
    return out.select("chunk_id", "ast_ok", F.explode_outer("findings").alias("x")).select("chunk_id", "ast_ok", "x.rule", "x.line", "x.message", "x.severity")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id and the verdict of each guard on the step from before to after, and on before as it stands."""
    texts = _defective(spark, d)
    wide = F.array(F.struct(F.lit(1).alias("lo"), F.lit(1_000_000).alias("hi")))
    plain = texts.select(
        "chunk_id", edits.register_mix(F.col("after")).alias("mix"), edits.register_mix(F.col("before")).alias("mix_before"), edits.order_flip(F.col("before"), F.col("after"), wide).alias("flipped"), *rewrite.input_flags(F.col("before")),
    )
    rows = texts.select("chunk_id", "before", F.explode(F.array(F.struct(F.lit("after").alias("side"), F.col("after").alias("text")), F.struct(F.lit("before").alias("side"), F.col("before").alias("text")))).alias("x"))
    parsed = code.guarded(rows.select("chunk_id", "before", "x.side", "x.text"), ["chunk_id", "side"], "before", "text")
    side = lambda c, s, n: F.max(F.when(F.col("side") == s, F.col(c))).alias(n)
    both = parsed.groupBy("chunk_id").agg(side("parses", "after", "parses"), side("parse_error", "after", "error"), side("interface_kept", "after", "interface_kept"), side("parses", "before", "parsed_before"), side("parse_error", "before", "error_before"))
    return plain.join(both, "chunk_id")


def q_guards(spark: SparkSession, d: str) -> DataFrame:
    """All guards on the step from the text with defects to the one without: passed, and the messages of those that fail."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("parses"), F.col("error")), F.when(~F.col("interface_kept"), "the interface of run has changed"), F.col("mix"), F.when(F.col("flipped"), "the order of two qubits has changed"),
    ))
    return _verdicts(spark, d).select("chunk_id", (F.size(reasons) == 0).alias("ok"), (4 - F.size(reasons)).alias("passed"), reasons.alias("reasons"))


def q_input_guards(spark: SparkSession, d: str) -> DataFrame:
    """Ten rows for every chunk with defects as it stands: four guards and six flags, each with passed and a detail where it fails."""
    flags = [F.struct(F.lit(n).alias("guard"), (~F.col(n)).alias("passed"), F.when(F.col(n), n).alias("detail")) for n, _ in rewrite.FLAGS]
    row = lambda name, passed, detail: F.struct(F.lit(name).alias("guard"), passed.alias("passed"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    rows = [
        row("ASTSyntaxOK", F.col("parsed_before"), F.col("error_before")), row("PassInterfaceOK", F.lit(True), none),
        row("QuantumRegisterSanityOK", F.col("mix_before").isNull(), F.col("mix_before")), row("QubitOrderHeuristicOK", F.lit(True), none),
    ]
    return _verdicts(spark, d).select("chunk_id", F.explode(F.array(*rows, *flags)).alias("x")).select("chunk_id", "x.*")


def q_region_guard(spark: SparkSession, d: str) -> DataFrame:
    """Does every edit of a donor lie inside the region of its lines? Without edits it does."""
    inside = F.size(edits.in_region(F.col("edits"), _region())) == F.size("edits")
    return _donors(spark, d).select("donor_id", inside.alias("passed"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Three replies for each donor, as a digit of its MD5 says: good at once, good in a fence after a broken one, all broken, or with edits out of range."""
    digit = F.left(F.md5(F.col("donor_id").cast("string")), F.lit(1))
    good = F.to_json(F.struct(F.slice("edits", 1, 1).alias("edits"), F.lit("derived").alias("rationale")))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), good, F.lit("\n```\n"))
    far = F.lit('{"edits": [{"start": 100000, "end": 100001, "replacement": "x"}]}')
    broken = F.lit("sorry, no edits")
    first = F.when(digit < "4", good).when(digit < "c", broken).otherwise(far)
    second = F.when(digit < "8", fenced).otherwise(broken)
    replies = _donors(spark, d).select("donor_id", "buggy_chunk", F.size("a").alias("n"), F.posexplode(F.array(first, second, broken)).alias("at", "raw"))
    allowed = F.array(F.struct(F.lit(1).alias("lo"), F.col("n").alias("hi")))
    return replies.select("donor_id", "buggy_chunk", (F.col("at") + 1).alias("attempt"), "raw", allowed.alias("allowed"))


def q_refine_replay(spark: SparkSession, d: str) -> DataFrame:
    """The first of three replayed replies that is valid and leaves no register mix-up; donors without any have no row."""
    guard = lambda df: df.withColumn("passed", edits.register_mix(edits.apply_edits(F.col("buggy_chunk"), F.col("edits"))).isNull())
    return proposals.accepted(_attempts(spark, d), "donor_id", guard=guard).select("donor_id", "attempt", F.size("edits").alias("edits"), "rationale", "no_op")


def q_chat_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Each donor as one flat chat: the task, its text as the user's turn, the text after as the answer, and an open last turn."""
    turn = lambda i, role, text: F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role"), text.alias("content"))
    turns = F.array(turn(0, "system", F.lit(TASK)), turn(1, "user", F.col("buggy_chunk")), turn(2, "assistant", F.col("fixed_chunk")))
    messages = _donors(spark, d).select("donor_id", F.explode(turns).alias("m")).select("donor_id", "m.*")
    chats = proposals.chat(messages, "donor_id", "turn")
    return chats.select("donor_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("chars"))


def q_prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every donor with every variant of the prompt: its size, the estimate in tokens, and whether it fits the budget."""
    shown = T.line_range(F.col("a"), F.lit(1), F.least(F.size("a"), F.lit(CODE_LINES)))
    sections = {"task": F.lit(TASK), "code": shown, "example": F.left("fixed_chunk", F.lit(600)), "rules": F.lit(RULES)}
    rows = [F.struct(F.lit(v).alias("variant"), F.concat_ws("\n\n", *(sections[s] for s in parts)).alias("prompt")) for v, parts in VARIANTS.items()]
    each = _donors(spark, d).select("donor_id", F.explode(F.array(*rows)).alias("x")).select("donor_id", "x.*")
    tokens = F.floor(F.length("prompt") / 3)
    return each.select("donor_id", "variant", F.length("prompt").alias("chars"), tokens.alias("tokens"), (tokens <= BUDGET).alias("fits"), F.md5("prompt").alias("prompt_md5"))


def queries() -> dict:
    every = (
        q_identifier_jaccard, q_apply_edits, q_edit_size, q_region_filter, q_lines_prf1, q_touched_prf1, q_regex_guards, q_order_guard, q_rule_rewrites, q_rule_lines, q_safe_rewrites, q_pattern_lines, q_input_flags,
        q_leak_free_pool, q_leak_free_windows, q_exemplar_pairs, q_diff, q_unified_diff, q_analyzer, q_guards, q_input_guards, q_region_guard, q_refine_replay, q_chat_prompt, q_prompt_variants,
    )
    return {f.__name__: f for f in every}


#: o donors, l their lines, e the ends they share (h, t), x the first edit (x1 to x2, its lines m) and the text after both edits (p).
_DONORS = f"""WITH o AS (SELECT * FROM {S.DONORS} WHERE length(buggy_chunk) > 0 AND length(fixed_chunk) > 0), l AS (SELECT *, {S.lines('buggy_chunk')} AS a, {S.lines('fixed_chunk')} AS b FROM o),
k AS (SELECT *, least(len(a), len(b)) AS s FROM l),
h AS (SELECT *, coalesce(list_min(list_filter(range(1, s + 1), lambda i: a[i] <> b[i])) - 1, s) AS h, coalesce(list_min(list_filter(range(1, s + 1), lambda i: a[len(a) + 1 - i] <> b[len(b) + 1 - i])) - 1, s) AS t0 FROM k),
e AS (SELECT * EXCLUDE (t0), least(t0, s - h) AS t FROM h),
x AS (SELECT *, h + 1 AS x1, len(a) - t AS x2, {S.lines("array_to_string(b[h + 1:len(b) - t], chr(10))")} AS m, {S.lines("a[1]")} AS one FROM e),
y AS (SELECT *, list_concat(a[1:h], m, a[greatest(x2, 0) + 1:]) AS step FROM x), p AS (SELECT *, list_concat(one, step[2:]) AS after FROM y)"""


def _changed(a: str, b: str, h: str, t: str) -> str:
    return f"list_filter(range(1, len({a}) + 1), lambda i: i > {h} AND i <= len({a}) - {t} AND NOT list_contains({b}[{h} + 1:len({b}) - {t}], {a}[i]))"


def _ends(a: str, b: str) -> tuple[str, str]:
    s = f"least(len({a}), len({b}))"
    h = f"coalesce(list_min(list_filter(range(1, {s} + 1), lambda i: {a}[i] <> {b}[i])) - 1, {s})"
    return h, f"least(coalesce(list_min(list_filter(range(1, {s} + 1), lambda i: {a}[len({a}) + 1 - i] <> {b}[len({b}) + 1 - i])) - 1, {s}), {s} - {h})"


_BEFORE = "WITH z AS " + defects.defective_sql(f"(SELECT chunk_id, CASE WHEN text IS NULL THEN [] ELSE {S.lines('text')} END AS ls FROM {S.CHUNKS})", "chunk_id", "ls")


def _rewriting() -> str:
    """CTEs: the lines after each step (w0 to w5), as the rules say."""
    q = lambda x: x.replace("'", "''")
    turned = "x"
    for _, pattern, new in rewrite.LINE_RULES:
        turned = f"regexp_replace({turned}, '{q(pattern)}', '{q(new)}', 'g')"
    names = f"list_transform(string_split(regexp_extract(x, '{q(rewrite.IMPORT)}', 1), ','), lambda n: trim(n))"
    left = f"list_filter({names}, lambda n: n <> 'execute')"
    bare = f"CASE WHEN regexp_matches(x, '{q(rewrite.IMPORT)}') AND list_contains({names}, 'execute') THEN CASE WHEN len({left}) > 0 THEN 'from qiskit import ' || array_to_string({left}, ', ') ELSE '' END ELSE x END"
    run = rewrite.RUN.replace("$", chr(92))
    return rf"""{_BEFORE}, w0 AS (SELECT chunk_id, before, {S.lines('before')} AS l0 FROM z), w1 AS (SELECT *, list_transform(l0, lambda x: {turned}) AS l1 FROM w0),
w2 AS (SELECT *, list_transform(l1, lambda x: regexp_replace(x, '{q(rewrite.EXECUTE)}', '{run}', 'g')) AS l2 FROM w1),
w2b AS (SELECT *, CASE WHEN l1 <> l2 AND NOT contains(l2[1], 'transpile') THEN coalesce(list_min(list_filter(range(1, len(l2) + 1), lambda i: regexp_matches(l2[i], 'from\s+qiskit\s+import\s+[^\n]+'))), 0) ELSE 0 END AS pos FROM w2),
w3 AS (SELECT *, list_transform(range(1, len(l2) + 1), lambda i: CASE WHEN i = pos AND NOT contains(l2[i], 'transpile') THEN rtrim(l2[i]) || ', transpile' ELSE l2[i] END) AS l3 FROM w2b),
w4 AS (SELECT *, list_transform(l3, lambda x: replace(x, '{rewrite.OLD_ACCOUNT}', '{rewrite.NEW_ACCOUNT}')) AS l4 FROM w3), w5 AS (SELECT *, list_transform(l4, lambda x: {bare}) AS l5 FROM w4),
w6 AS (SELECT *, array_to_string(l5, chr(10)) AS whole FROM w5), w7 AS (SELECT *, regexp_matches(whole, '\bAer\b') AND NOT regexp_matches(whole, '{q(rewrite.AER_IMPORT)}') AS aer,
  coalesce(list_max(list_filter(range(1, least(len(l5), 40) + 1), lambda i: starts_with(l5[i], 'import ') OR starts_with(l5[i], 'from '))), 0) AS place FROM w6)"""


def oracle_sql() -> dict[str, str]:
    ident = lambda c: f"list_distinct({S.tokens(c)})"
    q = lambda x: x.replace("'", "''")
    defect_rows = " UNION ALL ".join(f"SELECT kind, id, '{n}' AS defect, i AS line FROM l WHERE regexp_matches(x, '{q(p)}')" for n, p in rewrite.DEFECTS)
    flags = {n: f"regexp_matches(before, '{q(p)}')" for n, p in rewrite.FLAGS}
    flags["AerReferencedWithoutImport"] += f" AND NOT regexp_matches(before, '{q(rewrite.AER_FROM)}')"
    audited = " AND ".join([*(f"regexp_matches(before, '{q(p)}')" for p in rewrite.AUDIT), *(f"NOT regexp_matches(after, '{q(p)}')" for p in rewrite.AUDIT)])
    rules = [(r, f"len(list_filter(l0, lambda x: regexp_matches(x, '{q(p)}'))) > 0") for r, p, _ in rewrite.LINE_RULES]
    rules += [("R1", "l1 <> l2"), ("R5", f"contains(before, '{rewrite.OLD_ACCOUNT}')"), ("R6", "l4 <> l5"), ("R7", "aer")]
    fired = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in rules) + "], lambda x: x IS NOT NULL)))"
    step = lambda r, a, b: f"SELECT chunk_id, '{r}' AS rule, i AS line, {a}[i] AS before, {b}[i] AS after FROM (SELECT chunk_id, {a}, {b}, unnest(list_filter(range(1, len({a}) + 1), lambda i: {a}[i] <> {b}[i])) AS i FROM w7)"
    steps = " UNION ALL ".join(step(r, a, b) for r, a, b in (("line", "l0", "l1"), ("R1", "l1", "l2"), ("R1", "l2", "l3"), ("R5", "l3", "l4"), ("R6", "l4", "l5")))
    half = "list_filter([[x1, x2], [1, 1]], lambda r: r[1] >= donor_id % 2 + 1 AND r[2] <= (len(a) * 3) // 4)"
    h, t = _ends("a", "c")
    window = f"SELECT donor_id, unnest(range(0, len(a), {WINDOW - SHARED})) AS w, len(a) AS n FROM e WHERE case_id IN (SELECT case_id FROM {S.CASES} WHERE lower(trim(split)) LIKE 'tr%')"
    digit = "left(md5(donor_id::VARCHAR), 1)"
    sections = {"task": f"'{TASK}'", "code": f"array_to_string(a[1:{CODE_LINES}], chr(10))", "example": "left(fixed_chunk, 600)", "rules": f"'{RULES}'"}
    variants = " UNION ALL ".join(f"SELECT donor_id, '{v}' AS variant, " + " || chr(10) || chr(10) || ".join(sections[s] for s in parts) + " AS prompt FROM l" for v, parts in VARIANTS.items())
    return {
        "q_identifier_jaccard": _DONORS + f", j AS (SELECT donor_id, {ident('buggy_chunk')} AS x, {ident('fixed_chunk')} AS y FROM o), u AS (SELECT *, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u FROM j) SELECT donor_id, round(CASE WHEN u = 0 THEN 1.0 ELSE i / u END, 6) AS jaccard FROM u",
        "q_apply_edits": _DONORS + " SELECT donor_id, md5(array_to_string(after, chr(10))) AS patched_md5, after = b AS restored, x1 <= 1 AND 1 <= x2 AS overlap FROM p",
        "q_edit_size": _DONORS + " SELECT donor_id, greatest(x2 - x1 + 1, 0) + 1 AS touched, abs(len(m) - greatest(x2 - x1 + 1, 0)) + abs(len(one) - 1) AS change FROM p",
        "q_region_filter": _DONORS + f" SELECT donor_id, len({half}) AS kept, len({half}) = 0 AS no_op FROM p",
        "q_region_guard": _DONORS + f" SELECT donor_id, len({half}) = 2 AS passed FROM p",
        "q_lines_prf1": _DONORS + f""", c0 AS (SELECT *, x1 >= donor_id % 2 + 1 AND x2 <= (len(a) * 3) // 4 AS in1, donor_id % 2 = 0 AND 1 <= (len(a) * 3) // 4 AS in2 FROM p), c1 AS (SELECT *, CASE WHEN in1 THEN step ELSE a END AS mid FROM c0), c AS (SELECT *, {S.lines("coalesce(array_to_string(CASE WHEN in2 THEN list_concat(one, mid[2:]) ELSE mid END, chr(10)), '')")} AS c FROM c1),
            d AS (SELECT *, {h} AS ch, {t} AS ct FROM c), g AS (SELECT donor_id, {_changed('a', 'b', 'h', 't')} AS g, {_changed('a', 'c', 'ch', 'ct')} AS r FROM d),
            y2 AS (SELECT donor_id, len(g) AS gold_size, len(r) AS pred_size, len(list_intersect(g, r)) AS common FROM g), z AS (SELECT *, common / greatest(pred_size, 1) AS p0, common / greatest(gold_size, 1) AS r0 FROM y2)
            SELECT donor_id, round(p0, 6) AS p, round(r0, 6) AS r, round(CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END, 6) AS f1, gold_size, pred_size FROM z""",
        "q_regex_guards": _BEFORE + r""", c AS (SELECT chunk_id, before AS text, regexp_extract_all(before, '(\w+)\s*=\s*ClassicalRegister\(', 1) AS k, regexp_extract_all(before, 'measure\s*\(\s*([A-Za-z_]\w*)', 1) AS m,
            regexp_extract_all(before, '(cx|cz|rz|rx|ry|swap)\s*\(\s*([A-Za-z_]\w*)', 1) AS g, regexp_extract_all(before, '(cx|cz|rz|rx|ry|swap)\s*\(\s*([A-Za-z_]\w*)', 2) AS a FROM z),
            f AS (SELECT *, list_filter(m, lambda x: list_contains(k, x))[1] AS bad, list_filter(range(1, len(a) + 1), lambda i: list_contains(k, a[i]))[1] AS pos FROM c)
            SELECT chunk_id, coalesce('measure() uses classical register ''' || bad || ''' as quantum', g[pos] || '() uses classical register ''' || a[pos] || ''' as quantum') AS mix, len(list_distinct(regexp_extract_all(text, '(\w+)\s*=\s*QuantumRegister\(', 1))) AS quantum_registers FROM f""",
        "q_order_guard": _BEFORE + r" SELECT chunk_id, regexp_matches(after, '\bq\[\s*1\s*\]\s*,\s*q\[\s*0\s*\]') AND regexp_matches(before, '\bq\[\s*0\s*\]\s*,\s*q\[\s*1\s*\]') AS flipped FROM z",
        "q_rule_rewrites": _rewriting() + f" SELECT chunk_id, md5(array_to_string(CASE WHEN aer THEN list_concat(l5[1:place], ['{rewrite.NEW_AER}'], l5[place + 1:]) ELSE l5 END, chr(10))) AS patched_md5, array_to_string({fired}, ',') AS rules FROM w7",
        "q_rule_lines": _rewriting() + f" {steps} UNION ALL SELECT chunk_id, 'R7', place + 1, '', '{rewrite.NEW_AER}' FROM w7 WHERE aer",
        "q_pattern_lines": f"""{_BEFORE}, t AS (SELECT 'chunk' AS kind, chunk_id AS id, before AS text FROM z UNION ALL SELECT 'document', doc_id::VARCHAR, text FROM documents), a AS (SELECT kind, id, {S.lines('text')} AS ls FROM t WHERE text IS NOT NULL),
            l AS (SELECT kind, id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM a) SELECT * FROM ({defect_rows})""",
        "q_input_flags": _BEFORE + " SELECT chunk_id, " + ", ".join(f'{c} AS "{n}"' for n, c in flags.items()) + f", {audited} AS audited FROM z",
        "q_leak_free_pool": f"""WITH c AS (SELECT * FROM {S.CASES}), o AS (SELECT * FROM {S.DONORS}), t AS (SELECT case_id FROM c WHERE lower(trim(split)) LIKE 'tr%'), n AS (SELECT count(*) AS shared FROM o WHERE case_id IN (SELECT case_id FROM t)),
            w AS (SELECT case_id, count(*) AS own FROM o GROUP BY case_id) SELECT c.case_id, coalesce(own, 0) AS own, shared + CASE WHEN t.case_id IS NULL THEN coalesce(own, 0) ELSE 0 END AS usable FROM c LEFT JOIN w USING (case_id) LEFT JOIN t USING (case_id), n""",
        "q_leak_free_windows": _DONORS + f""", w AS ({window}), r AS (SELECT donor_id, w + 1 AS start_line, least(w + {WINDOW}, n) AS end_line FROM w), g AS (SELECT donor_id, unnest({_changed('a', 'b', 'h', 't')}) AS line FROM e)
            SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.donor_id = r.donor_id AND line BETWEEN start_line AND end_line)""",
        "q_exemplar_pairs": _DONORS + f", r AS (SELECT *, greatest(h + 1 - {PAD}, 1) AS lo, least(greatest(len(a) - t, h + 1) + {PAD}, len(a)) AS hi FROM e) SELECT donor_id, lo, hi, md5(coalesce(array_to_string(a[lo:hi], chr(10)), '')) AS buggy_md5, md5(coalesce(array_to_string(b[lo:hi], chr(10)), '')) AS fixed_md5 FROM r",
        "q_refine_replay": _DONORS + f", r AS (SELECT donor_id, {digit} AS g FROM o) SELECT donor_id, CASE WHEN g < '4' OR g >= 'c' THEN 1 ELSE 2 END AS attempt, CASE WHEN g >= 'c' THEN 0 ELSE 1 END AS edits, CASE WHEN g >= 'c' THEN '' ELSE 'derived' END AS rationale, g >= 'c' AS no_op FROM r WHERE g < '8' OR g >= 'c'",
        "q_chat_prompt": _DONORS + f", r AS (SELECT donor_id, '{TASK}' || chr(10) || 'USER:' || chr(10) || buggy_chunk || chr(10) || 'ASSISTANT:' || chr(10) || fixed_chunk || chr(10) || 'ASSISTANT:' AS prompt FROM o) SELECT donor_id, md5(prompt) AS prompt_md5, length(prompt) AS chars FROM r",
        "q_prompt_variants": _DONORS + f", v AS ({variants}) SELECT donor_id, variant, length(prompt) AS chars, length(prompt) // 3 AS tokens, length(prompt) // 3 <= {BUDGET} AS fits, md5(prompt) AS prompt_md5 FROM v",
    }

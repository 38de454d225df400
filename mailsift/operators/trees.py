"""Boolean trees in a batch (B1 x T4-T6): and / or / not over clauses, many queries at once.

A query is a row of ``programs``: its tree in postfix form, an array of ints. A number from 0 on is a clause of
the criteria table (``clause_id``) and pushes whether it holds; ``AND``, ``OR`` and ``NOT`` work on the top of the stack.

1. *Drivers.* A fold over the program finds the clauses that a match cannot do without: of an AND the
   lighter side, of an OR both, of a NOT none. Weights come from the gram statistics (postings)
   and the clause itself (state). Messages that hold a driver are the candidates; a query without
   drivers (only negations) meets the messages of its mailbox instead.
2. *Hits.* Candidates alone meet all clauses of their query, postings by (mailbox, uid, field) and
   state by key; each hit sets a bit, and a message has one bit mask for each 64 clauses of a query.
3. *Evaluation.* A fold over the program with a bit stack in one long: shifts, ands and ors of built-in functions.

Neutral clauses (`all`, text without a token, uid `*`) are true. A clause with several rows (tokens, uid
ranges) holds if one of them does.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators import batch as B
from mailsift.operators.ingest import term_dictionary
from mailsift.session import materialize

NOT, AND, OR = -1, -2, -3
#: Bits of the evaluation stack.
DEPTH = 62
CRITERIA = "query_id bigint, mailbox_id string, clause_id bigint, kind string, name string, value string, lo bigint, hi bigint"
PROGRAMS = "query_id bigint, mailbox_id string, program array<int>"
KEYS = ["query_id", "mailbox_id", "uid"]
_INF = float("inf")


# --------------------------------------------------------------------- programs

def compile_tree(tree) -> tuple[list[list[dict]], list[int]]:
    """(clauses, program) of a nested tree: ``("and", t, ...)``, ``("or", t, ...)``, ``("not", t)``, or a clause: a
    dict of criteria columns, or a list of dicts for a clause of several rows (uid ranges).

    Negations are moved down to the clauses, where they cost the drivers least."""
    clauses: list[list[dict]] = []

    def walk(node, negated: bool) -> tuple[list[int], int]:
        """(program, stack it needs)"""
        if isinstance(node, (dict, list)):
            rows = [node] if isinstance(node, dict) else node
            if rows not in clauses:
                clauses.append(rows)
            return [clauses.index(rows)] + ([NOT] if negated else []), 1
        op, *kids = node
        if op == "not" and len(kids) == 1:
            return walk(kids[0], not negated)
        if op not in ("and", "or") or not kids:
            raise ValueError(f"unsupported tree: {node!r}")
        # the deepest side first keeps the stack low
        parts = sorted((walk(k, negated) for k in kids), key=lambda p: -p[1])
        out, need = list(parts[0][0]), parts[0][1]
        for program, depth in parts[1:]:
            out += program + [OR if (op == "or") != negated else AND]
            need = max(need, depth + 1)
        return out, need

    program, need = walk(tree, False)
    if need > DEPTH:
        raise ValueError(f"a tree may need a stack of {DEPTH} at most, this one needs {need}")
    return clauses, program


def compile_batch(spark: SparkSession, queries: Iterable[tuple]) -> tuple[DataFrame, DataFrame]:
    """(criteria, programs) from (query_id, mailbox_id or None, tree) entries."""
    rows, programs = [], []
    for query_id, mailbox, tree in queries:
        clauses, program = compile_tree(tree)
        programs.append((query_id, mailbox, program))
        rows += [(query_id, mailbox, k, r["kind"], r.get("name"), r.get("value"), r.get("lo"), r.get("hi"))
                 for k, clause in enumerate(clauses) for r in clause]
    return spark.createDataFrame(rows, CRITERIA), spark.createDataFrame(programs, PROGRAMS)


# --------------------------------------------------------------------- evaluation

def evaluate(program: Column, masks: Column) -> Column:
    """Truth of a postfix program over bit masks (array of longs, 64 clauses in each)."""
    one = F.lit(1).cast("bigint")

    def step(stack: Column, t: Column) -> Column:
        # not in a branch of its own: the fold reads the word of a clause only
        at = F.greatest(t, F.lit(0))
        word = F.get(masks, F.floor(at / 64).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, at % 64).bitwiseAND(one)
        below = F.shiftright(stack, 1)
        return F.when(t >= 0, F.shiftleft(stack, 1).bitwiseOR(bit)) \
            .when(t == NOT, stack.bitwiseXOR(one)) \
            .when(t == AND, below.bitwiseAND(stack.bitwiseOR(F.bitwise_not(one)))) \
            .otherwise(below.bitwiseOR(stack.bitwiseAND(one)))

    return F.aggregate(program, F.lit(0).cast("bigint"), step).bitwiseAND(one) == 1


def drivers(program: Column, weights: Column) -> Column:
    """struct(w, d): the clauses one of which every match holds, and the sum of their weights; infinite if there are none."""
    item = "struct<w:double,d:array<int>>"

    def entry(w: Column, d: Column) -> Column:
        return F.array(F.struct(w.alias("w"), d.alias("d")).cast(item))

    def step(stack: Column, t: Column) -> Column:
        x, y = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
        lighter = F.when(x["w"] <= y["w"], x).otherwise(y)
        rest = lambda n: F.slice(stack, F.lit(n + 1), F.greatest(F.size(stack) - n, F.lit(0)))
        return F.when(t >= 0, F.concat(entry(F.coalesce(F.try_element_at(weights, t.cast("bigint")), F.lit(_INF)), F.array(t)), stack)) \
            .when(t == NOT, F.concat(entry(F.lit(_INF), F.array().cast("array<int>")), rest(1))) \
            .when(t == AND, F.concat(F.array(lighter), rest(2))) \
            .otherwise(F.concat(entry(x["w"] + y["w"], F.concat(x["d"], y["d"])), rest(2)))

    return F.get(F.aggregate(program, F.array().cast(f"array<{item}>"), step), F.lit(0))


# --------------------------------------------------------------------- search

def _weights(crit: DataFrame, pick: DataFrame | None) -> DataFrame:
    """(query_id, weights map): messages that a clause may hold, roughly; neutral and negative clauses are no drivers."""
    k = F.col("kind")
    state = F.when(k == "uid", F.greatest(F.lit(1.0), F.col("hi").cast("double") - F.col("lo").cast("double") + 1)) \
        .when(k.isin("size_eq", "size_lt", "size_gt", "date_between"), 1e12).when(k == "flag_set", 1e13).otherwise(_INF)
    rows = crit.where(F.col("field").isNull()).select("query_id", "clause_id", state.alias("w"))
    if pick is not None:
        token = F.when(F.length("qterm") < B.GRAM, B.SHORT_WEIGHT).when(F.col("n") > 0, F.col("docs").cast("double")).otherwise(0.0)
        rows = rows.unionByName(crit.where(F.col("field").isNotNull()).join(pick.select("field", "qterm", "n", "docs"), ["field", "qterm"], "left")
                                .select("query_id", "clause_id", token.alias("w")))
    return rows.groupBy("query_id", "clause_id").agg(F.sum("w").alias("w")) \
        .groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("clause_id", "w"))).alias("weights"))


def search_trees(postings: DataFrame, state: DataFrame, criteria: DataFrame, programs: DataFrame, dictionary: DataFrame | None = None,
                 grams: DataFrame | None = None, gram_stats: DataFrame | None = None) -> DataFrame:
    """(query_id, mailbox_id, uid) of every message that a query's program accepts."""
    crit = materialize(B.expand_criteria(criteria), "criteria")
    st = state.select("mailbox_id", "uid", "flags", "size", "internal_date")
    post = postings.select("mailbox_id", "uid", "field", "term")
    tokens = crit.where("field is not null").select("query_id", "clause_id", F.col("mailbox_id").alias("q_mailbox"), "field", "qterm")
    on_state = crit.where(F.col("kind").isin(*B.STATE_KINDS))
    has_p, has_s = bool(tokens.take(1)), bool(on_state.take(1))
    pick = None
    if has_p:
        dictionary = term_dictionary(postings) if dictionary is None else dictionary
        grams = B.gram_index(dictionary) if grams is None else grams
        gram_stats = B.gram_statistics(grams) if gram_stats is None else gram_stats
        pick = B.rarest_grams(tokens.select("field", "qterm").distinct(), gram_stats)

    # the query set: programs with the masks of their neutral clauses and their drivers
    words = (criteria.agg(F.max("clause_id")).first()[0] or 0) // 64 + 1
    effective = crit.where("kind != 'all'").select("query_id", "clause_id").distinct()
    neutral = criteria.select("query_id", "clause_id").distinct().join(effective, ["query_id", "clause_id"], "left_anti")
    plan = programs.select("query_id", F.col("mailbox_id").alias("q_mailbox"), "program") \
        .join(_masks(neutral, ["query_id"], words), "query_id", "left").join(_weights(crit, pick), "query_id", "left")
    no_mask = F.array(*[F.lit(0).cast("bigint")] * words)
    plan = plan.withColumns({"masks": F.coalesce("masks", no_mask), "drv": drivers(F.col("program"), F.coalesce("weights", F.create_map().cast("map<bigint,double>")))})
    plan = materialize(plan.select("query_id", "q_mailbox", "program", "masks", (F.col("drv.w") == _INF).alias("whole"), F.col("drv.d").alias("d")), "programs")

    drv = plan.where(~F.col("whole")).select("query_id", F.explode(F.col("d").cast("array<bigint>")).alias("clause_id")).distinct()
    found = []
    if has_p:
        d_tok = materialize(tokens.join(drv, ["query_id", "clause_id"]), "driver-tokens")
        d_q = d_tok.select("field", "qterm").distinct()
        terms = B.match_terms(dictionary, d_q, grams, gram_stats)
        asked = terms.join(d_tok, ["field", "qterm"]).select("query_id", "q_mailbox", "field", "term").distinct()
        found.append(post.join(asked, ["field", "term"]).where(B._mailbox_ok()).select(*KEYS))
    if has_s:
        found.append(B._state_hits(st, on_state.join(drv, ["query_id", "clause_id"], "left_semi")).select(*KEYS))
    whole = plan.where("whole").select("query_id", "q_mailbox")
    found.append(st.join(whole, F.col("mailbox_id") == F.col("q_mailbox")).select(*KEYS))
    everywhere = whole.where("q_mailbox is null").select("query_id")
    if everywhere.take(1):  # negations over all mailboxes: each such query's result is most messages
        found.append(st.select("mailbox_id", "uid").join(everywhere).select(*KEYS))
    cand = materialize(reduce(lambda a, b: a.unionByName(b), found).distinct(), "candidates")

    hits = [cand.select(*KEYS, F.lit(None).cast("bigint").alias("clause_id"))]
    if has_p:
        asked = cand.join(tokens.drop("q_mailbox"), "query_id")
        hits.append(B.held_tokens(post, asked).select(*KEYS, "clause_id"))
    if has_s:
        clauses = on_state.select("query_id", "clause_id", "kind", "qterm", "lo", "hi")
        hits.append(cand.join(st, ["mailbox_id", "uid"]).join(clauses, "query_id").where(B._state_condition()).select(*KEYS, "clause_id"))
    masks = _masks(reduce(lambda a, b: a.unionByName(b), hits), KEYS, words)
    both = F.zip_with("own", "masks", lambda a, b: a.bitwiseOR(b))
    return masks.withColumnRenamed("masks", "own").join(plan.select("query_id", "program", "masks"), "query_id") \
        .where(evaluate(F.col("program"), both)).select(*KEYS)


def _masks(hits: DataFrame, keys: list[str], words: int) -> DataFrame:
    """Bit masks of the clauses hit (``clause_id``, NULL: none) for each key."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("clause_id") % 64).cast("int"))
    word = F.floor(F.col("clause_id") / 64)
    return hits.groupBy(*keys).agg(F.array(*[F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("bigint")) for k in range(words)]).alias("masks"))

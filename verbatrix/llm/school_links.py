"""Problem 2: schools and candidate sites matched without a shared id, by soft logic.

Each candidate is reduced to a mention (host, title, place); equal mentions are judged once. Words that many titles and no
school's name hold are learnt from the tables as words around names. Mentions meet institutions by blocking keys only:
forms of the name with a character deleted, host suffixes, host labels. For every pair, weighted rules with squared hinge
losses say what speaks for and against the match m(mention, school):

    name alike, kind alike -> m    host of the school's site -> m    label of the school's name -> m    place agrees -> m
    page of another sort -> not m    kind differs -> not m    place differs -> not m    nothing known -> not m
    exclusivity: the schools of one mention sum to at most 1, and so do the schools of one host
    transitivity: mentions of one host agree with its value y(host, school), for every school that holds a share of it

The sum is convex. It is solved by alternating directions: every mention solves its own small problem with private copies
of its host's values; the copies are averaged and brought back to the host's exclusivity, and scaled duals carry the
disagreement into the next round, until no value moves and no copy stands apart by more than RESIDUAL. The rows of a round
are independent, so a hot host is spread over all tasks, and only partial sums are shuffled. The value of m is the
confidence. Mentions without evidence of their own don't vote; they take their host's values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.llm.arrow import map_batches
from verbatrix.llm.school_names import AROUND, NOT_A_SCHOOL, SCHOOL_WORDS, deletions, edit_distance, host_of, label_stems, parse_name, school_labels, squeezed, tokens_of
from verbatrix.operators.sizing import join_measured, join_written, materialise

#: Rule weights: for (a name alike to 1, an edit away, its host, its label, its place), against.
FOR = {"name": 6.0, "near": 4.0, "host": 8.0, "label": 6.0, "place": 1.0}
AGAINST = {"prior": 1.0, "unknown": 0.3, "sort": 14.0, "kind": 8.0, "place": 2.0}
#: Weight of the agreement of a mention with its host, penalty of the alternating directions, most rounds (more are an error),
#: stopping residual.
AGREE, RHO, ROUNDS, RESIDUAL = 1.0, 4.0, 40, 0.01
#: Share of a host's evidence from which a school has a value of its own there: at most 1 / SHARE schools can reach it, and
#: one below it can't carry a mention past 0.5.
SHARE = 0.25
#: A word stands around names if so many titles hold it, and this share of all titles, which bounds their number by the words
#: of a title over the share, and if no one other word stands in more than PARTNER_SHARE of them.
AROUND_TIMES, AROUND_SHARE, PARTNER_SHARE = 8, 0.001, 0.5
STATE = re.compile(r"\b[A-Z]{2}\b")


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _title_words(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Every word of at least four letters of a title, with the others that don't stand around names or name a kind of school; the first partner is the word itself."""
    for b in batches:
        out: dict[str, list] = {"word": [], "partner": []}
        for title in b["title"]:
            words = {w for w in tokens_of(title) if len(w) >= 4 and w not in AROUND and w not in SCHOOL_WORDS}
            for w in words:
                out["word"].extend([w] * len(words))
                out["partner"].extend([w, *(words - {w})])
        yield out


def _name_words(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for b in batches:
        yield {"word": [w for name in b["name"] for w in {*tokens_of(name), parse_name(name)[0]}]}


def around_words(institutions: DataFrame, mentions: DataFrame) -> frozenset[str]:
    """Words of at least four letters that many titles hold beside ever other words, and no school's name.

    Words that come with one and the same other word most of the time are parts of one much mentioned name.
    """
    titles = mentions.select("title").filter("title IS NOT NULL").distinct()
    least = max(AROUND_TIMES, AROUND_SHARE * titles.count())
    pairs = map_batches(titles, _title_words, "word string, partner string").groupBy("word", "partner").agg(F.count(F.lit(1)).alias("n"))
    words = pairs.groupBy("word").agg(F.max(F.when(F.col("word") == F.col("partner"), F.col("n"))).alias("titles"), F.max(F.when(F.col("word") != F.col("partner"), F.col("n"))).alias("partner"))
    often = words.filter((F.col("titles") >= least) & (F.coalesce("partner", F.lit(0)) <= PARTNER_SHARE * F.col("titles"))).select("word")
    names = map_batches(institutions.select("name").filter("name IS NOT NULL"), _name_words, "word string").distinct()
    return frozenset(r["word"] for r in often.join(names, "word", "left_anti").collect())


def _school_keys(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for b in batches:
        out: dict[str, list] = {"key": [], "unitid": []}
        for unit, name, website in zip(b["unitid"], b["name"], b["website"]):
            core, kind = parse_name(name) if name else ("", "")
            host = host_of(website)
            keys = {f"c:{x}" for x in deletions(core)} if len(core) > 3 else {f"c:{core}"} if core else set()
            keys |= {f"l:{x}" for x in school_labels(core, kind)}
            if host:
                keys |= {f"h:{host}", f"l:{squeezed(host.rsplit('.', 1)[0])}"}
            out["key"].extend(map(_key, keys))
            out["unitid"].extend([unit] * len(keys))
        yield out


def _mention_keys(around: frozenset[str]):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {"key": [], "mention": []}
            for mention, host, title in zip(b["mention"], b["host"], b["title"]):
                keys = set()
                core, _ = parse_name(title, around) if title else ("", "")
                if core:
                    keys |= {f"c:{x}" for x in deletions(core)} if len(core) > 3 else {f"c:{core}"}
                labels = host.split(".")
                for i, label in enumerate(labels[:-1]):
                    keys.add("h:" + ".".join(labels[i:]))
                    keys |= {f"l:{x}" for x in label_stems(label, around)}
                keys.add("l:" + squeezed("".join(labels[:-1])))
                out["key"].extend(map(_key, keys))
                out["mention"].extend([mention] * len(keys))
            yield out

    return run


def _evidence(around: frozenset[str]):
    names = ("mention", "host", "unitid", "pro", "con")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for mention, host, title, snippet, unit, name, website, city, state in zip(b["mention"], b["host"], b["title"], b["snippet"], b["unitid"], b["name"], b["website"], b["city"], b["state"]):
                core, kind = parse_name(name) if name else ("", "")
                said, said_kind = parse_name(title, around) if title else ("", "")
                pro, con = 0.0, AGAINST["prior"]
                if said and core and (edits := edit_distance(said, core, 1)) <= 1:
                    if said_kind == kind:
                        pro += FOR["near" if edits else "name"]
                    elif said_kind:
                        con += AGAINST["kind"]
                        pro += FOR["name"] / 4
                    else:
                        pro += FOR["name"] / 4
                site = host_of(website)
                labels = host.split(".")[:-1]
                if site and (host == site or host.endswith("." + site)):
                    pro += FOR["host"]
                else:
                    wanted = {*school_labels(core, kind), *([squeezed(site.rsplit(".", 1)[0])] if site else [])}
                    if any(x in wanted for label in labels for x in label_stems(label, around)):
                        pro += FOR["label"]
                if not pro:
                    continue
                if title and NOT_A_SCHOOL.search(title):
                    con += AGAINST["sort"]
                if snippet and city and state and (states := STATE.findall(snippet)):
                    if state in states and city.strip().casefold() in snippet.casefold():
                        pro += FOR["place"]
                    else:
                        con += AGAINST["place"]
                for key, value in zip(names, (mention, host, unit, pro, con)):
                    out[key].append(value)
            yield out

    return run


def _silent(around: frozenset[str]):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            kept = [(m, h) for m, h, t in zip(b["mention"], b["host"], b["title"]) if not t or not parse_name(t, around)[0] and not NOT_A_SCHOOL.search(t)]
            yield {"mention": [m for m, _ in kept], "host": [h for _, h in kept]}

    return run


def mentions_of(candidates: DataFrame) -> DataFrame:
    """candidates (id, domain, title, snippet) with their host and mention key; a null domain leaves an empty host."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim("domain")), r"^(?:[a-z][a-z0-9+.-]*://)?([^/:?#\s]+)", 1), r"^www\.", "")
    title = F.trim(F.regexp_replace(F.col("title"), r"\s+", " "))
    rows = candidates.select("id", F.coalesce(host, F.lit("")).alias("host"), F.when(F.length(title) > 0, title).alias("title"), "snippet")
    return rows.withColumn("mention", F.xxhash64("host", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))


def evidence_pairs(institutions: DataFrame, mentions: DataFrame, around: frozenset[str]) -> DataFrame:
    """(mention, host, unitid, pro, con): every pair that meets in a blocking key and has something for it."""
    schools = institutions.select("unitid", "name", "website", "city", "state").filter(F.col("unitid").isNotNull()).dropDuplicates(["unitid"])
    kind = schools.schema["unitid"].dataType.simpleString()
    index = map_batches(schools.select("unitid", "name", "website"), _school_keys, f"key bigint, unitid {kind}")
    keys = map_batches(mentions.select("mention", "host", "title"), _mention_keys(around), "key bigint, mention bigint")
    met = join_measured(keys, index, ["key"]).select("mention", "unitid").distinct()
    rows = join_measured(met.join(mentions, "mention"), schools, ["unitid"])
    return map_batches(rows.select("mention", "host", "title", "snippet", "unitid", "name", "website", "city", "state"), _evidence(around), f"mention bigint, host string, unitid {kind}, pro double, con double")


def _fit(pull: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The least sum of slope*m^2 - 2*pull*m with m >= 0 and a sum of at most 1."""
    m = pull / slope
    if m.sum() > 1:  # exclusivity: one multiplier, found by bisection
        low, high = 0.0, float(2 * pull.max())
        for _ in range(50):
            mid = (low + high) / 2
            if np.maximum(0, (pull - mid / 2) / slope).sum() > 1:
                low = mid
            else:
                high = mid
        m = np.maximum(0, (pull - high / 2) / slope)
    return m


def _solve(pro: np.ndarray, con: np.ndarray, tied: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mention's own problem: squared hinges pro*(1-m)^2 + con*m^2, agreement of every tied m with the copy x of its host's
    value, and x near target; m >= 0, sum of m <= 1. Returns m and x (meaningless where nothing is tied)."""
    # eliminating x = (AGREE*m + RHO/2*target) / (AGREE + RHO/2) leaves one quadratic in m
    c = np.where(tied, AGREE * (RHO / 2) / (AGREE + RHO / 2), 0.0)
    m = _fit(pro + c * target, pro + con + c)
    return m, (AGREE * m + RHO / 2 * target) / (AGREE + RHO / 2)


def _round(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """pairs: (unitid, pro, con, y, x, dual) of one mention, y null where the host has no value for the school."""
    for b in batches:
        out = []
        for pairs in b["pairs"]:
            y = np.array([np.nan if p["y"] is None else p["y"] for p in pairs])
            tied = ~np.isnan(y)
            dual = np.array([p["dual"] for p in pairs])
            m, x = _solve(np.array([p["pro"] for p in pairs]), np.array([p["con"] for p in pairs]), tied, np.where(tied, y - dual, 0.0))
            out.append([{**p, "x": float(a) if t else None, "m": float(v)} for p, a, t, v in zip(pairs, x, tied, m)])
        yield {"mention": b["mention"], "host": b["host"], "pairs": out}


def _exclusive(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Every host's averages brought to a sum of at most 1."""
    for b in batches:
        fitted = [_fit(np.clip([v["a"] for v in values], 0.0, None), np.ones(len(values))).tolist() for values in b["values"]]
        yield {"host": b["host"], "news": [[(v["unitid"], y) for v, y in zip(values, f)] for values, f in zip(b["values"], fitted)]}


def _host_values(pairs: DataFrame, value: str, kind: str) -> DataFrame:
    """(host, news): a map from unitid to the mean of a column of (host, unitid) rows, exclusive within the host; a host has few schools here."""
    means = pairs.groupBy("host", "unitid").agg(F.avg(value).alias("a")).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("unitid", "a"))).alias("values"))
    return materialise(map_batches(means, _exclusive, f"host string, news map<{kind},double>"))


def settle(pairs: DataFrame, rounds: int = ROUNDS, residual: float = RESIDUAL) -> tuple[DataFrame, DataFrame, float]:
    """((mention, host, unitid, m), (host, unitid, y), residual) of pairs (mention, host, unitid, pro, con).

    Ends when neither a host's value moves nor a copy stands apart from it by more than `residual`; an error if `rounds`
    don't reach that, as values in between are no answer.
    """
    kind = pairs.schema["unitid"].dataType.simpleString()
    first = pairs.withColumn("v", F.col("pro") / (F.col("pro") + F.col("con")))
    voices = first.groupBy("host").agg(F.count_distinct("mention").alias("told"))
    shares = first.groupBy("host", "unitid").agg(F.sum("v").alias("v")).join(voices, "host").filter((F.col("v") >= SHARE * F.col("told")) & (F.col("host") != "")).select("host", "unitid")
    start = join_measured(first, shares, ["host", "unitid"], "left_semi")
    hosts = _host_values(start, "v", kind)
    grouped = pairs.groupBy("mention", "host").agg(F.sort_array(F.collect_list(F.struct("unitid", "pro", "con"))).alias("pairs"))

    def pair(p: Column, y: Column, x: Column, dual: Column, m: Column, **more: Column) -> Column:
        return F.struct(p["unitid"].alias("unitid"), p["pro"].alias("pro"), p["con"].alias("con"), y.alias("y"), x.alias("x"), dual.alias("dual"), m.alias("m"), *(c.alias(n) for n, c in more.items()))

    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    told = lambda p: F.try_element_at("news", p["unitid"])
    state = join_written(grouped, hosts, ["host"], "left").select("mention", "host", F.transform("pairs", lambda p: pair(p, told(p), none, zero, zero)).alias("pairs"))
    schema = f"mention bigint, host string, pairs array<struct<unitid:{kind},pro:double,con:double,y:double,x:double,dual:double,m:double>>"
    for _ in range(rounds):
        solved = materialise(map_batches(state, _round, schema))
        each = solved.select("host", F.explode("pairs").alias("p")).filter("p.y IS NOT NULL").select("host", "p.unitid", (F.col("p.x") + F.col("p.dual")).alias("at"))
        hosts = _host_values(each, "at", kind)
        # both residuals: how far the hosts' values moved, and how far the copies stand from them
        moved = F.transform("pairs", lambda p: pair(p, F.when(p["y"].isNotNull(), told(p)), p["x"], F.coalesce(p["dual"] + p["x"] - told(p), zero), p["m"], gap=F.greatest(F.abs(told(p) - p["y"]), F.abs(p["x"] - told(p)))))
        step = join_written(solved, hosts, ["host"], "left").select("mention", "host", moved.alias("pairs"))
        gap = step.agg(F.max(F.array_max(F.transform("pairs", lambda p: p["gap"])))).first()[0] or 0.0
        if gap <= residual:
            break
        state = step.select("mention", "host", F.transform("pairs", lambda p: p.dropFields("gap")).alias("pairs"))
    else:
        raise ArithmeticError(f"the links did not settle: residual {gap:.4f} after {rounds} rounds")
    values = solved.select("mention", "host", F.explode("pairs").alias("p")).select("mention", "host", "p.unitid", "p.m")
    return values, hosts.select("host", F.explode("news").alias("unitid", "y")), gap


def school_links(institutions: DataFrame, candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(unitid, candidate_id, confidence) of every pair with evidence, own or by its host; a match has 0.5 or more.

    institutions: unitid, name, website, city, state; candidates: id, domain, title, snippet. Nulls only leave out the
    evidence they would give; repeated candidates give a row each, repeated schools count once; empty tables give nothing.
    A candidate without evidence of its own, and without another school's name in its title, takes its host's values.
    """
    found = materialise(mentions_of(candidates))
    mentions = found.select("mention", "host", "title", "snippet").dropDuplicates(["mention"])
    around = around_words(institutions, mentions)
    pairs = materialise(evidence_pairs(institutions, mentions, around))
    values, y, _ = settle(pairs, rounds)
    # a mention that names a school of its own, or is a page of another sort, is no silent one
    rest = map_batches(mentions.join(pairs.select("mention").distinct(), "mention", "left_anti").select("mention", "host", "title"), _silent(around), "mention bigint, host string")
    taken = join_measured(rest, y, ["host"]).select("mention", "unitid", (F.col("y") * AGREE / (AGREE + AGAINST["unknown"])).alias("m"))
    scored = values.select("mention", "unitid", "m").unionByName(taken).select("mention", "unitid", F.round("m", 4).alias("confidence"))
    return found.select(F.col("id").alias("candidate_id"), "mention").join(scored, "mention").select("unitid", "candidate_id", "confidence")

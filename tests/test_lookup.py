"""Pattern lookups (literal, prefix, general wildcard) against brute force."""

import random
import re

from pyspark.sql import functions as F

from regimen.operators import lookup as B
from regimen.sources.tables import complete, literal_table


def test_routine_name_like_matches_pairwise_ilike(spark):
    rnd = random.Random(5)
    words = ["Push", "push day", "Pull", "Legs", "Leg press", "Plan 1", "Plan 12", "Core", "a", "ab", "abc"]
    routines, requests = [], []
    for u in range(40):
        for k in rnd.sample(words, rnd.randrange(0, 5)):
            routines.append((f"r{u}:{k}", k, u, rnd.random() < 0.8, False))
    patterns = ["push", "PUSH%", "pu%", "%", "Plan _", "Plan 1%", "leg%", "a%", "ab%", "abd%", "%ss",
                "l_gs", "zzz%", "Core"]
    for i in range(300):
        requests.append((i, rnd.randrange(40), rnd.choice(patterns)))
    m = complete(spark, {"setup_routines": literal_table(spark, "setup_routines", routines)})
    req = spark.createDataFrame(requests, "request_id int, user_id int, pattern string")
    got = {r.request_id: r.exists for r in B.routine_name_like(m, req).collect()}
    brute = (req.join(m.setup_routines.filter("routine_created").select("user_id", "name"), "user_id", "left")
             .groupBy("request_id").agg(F.coalesce(F.max(F.expr("name ILIKE pattern")), F.lit(False)).alias("e")))
    want = {r.request_id: r.e for r in brute.collect()}
    assert got == want


def test_patterns_of_a_hot_user_match_brute_force(spark):
    """One user holds a third of all names; pieces of every length, escapes, lengths only, grams that no name holds."""
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice("abcAB _%é\\") for _ in range(n))
    routines = [(f"r{k}", make(rnd.randint(1, 9)), 0 if k % 3 == 0 else rnd.randint(1, 9), True, False) for k in range(900)]
    pieces = ["%", "_", "a", "ab", "abc", "b a", "\\%", "\\_", "\\\\", "é", "cab", "zq"]
    requests = [(i, 0 if i % 3 == 0 else rnd.randint(1, 9), "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 5)))) for i in range(600)]
    requests += [(1000 + n, 0, "_" * n + tail) for n in range(12) for tail in ("", "%") if n or tail] + [(2000, 0, "%%"), (2001, 99, "%a%"), (2002, None, "%a%")]
    requests = list({i: (i, u, p) for i, u, p in requests}.values())
    m = complete(spark, {"setup_routines": literal_table(spark, "setup_routines", routines)})
    req = spark.createDataFrame(requests, "request_id int, user_id int, pattern string")
    got = {r.request_id: r.exists for r in B.routine_name_like(m, req).collect()}
    names = {}
    for _, name, u, _, _ in routines:
        names.setdefault(u, []).append(name.lower())

    def ilike(pattern, name):
        out, k = [], 0
        while k < len(pattern):
            c = pattern[k]
            if c == "\\":
                k += 1
                out.append(re.escape(pattern[k].lower()))
            else:
                out.append({"%": ".*", "_": "."}.get(c, re.escape(c.lower())))
            k += 1
        return re.fullmatch("".join(out), name, re.S) is not None

    assert got == {i: any(ilike(p, n) for n in names.get(u, [])) for i, u, p in requests}
    assert 50 < sum(got.values()) < len(got) - 50

"""Moderation against one request at a time."""

import datetime
import random

from tidemark.operators import moderation as M

T0 = datetime.datetime(2024, 1, 1)


def test_equals_a_fold(spark):
    r = random.Random(9)
    admins = [(1, "owner", True), (2, "moderator", True), (3, "moderator", False), (4, "owner", False)]
    entries = [(k, i, "pending", None, None, i % 4) for k in M.REVIEWS for i in range(6)] + [("opportunity", 6, "active", T0, T0 + datetime.timedelta(9), 2), ("profile", 7, "verified", T0, T0, None)]
    asks, looks = [], []
    for seq in range(400):
        if r.random() < 0.4:
            asks.append((seq, r.choice([1, 1, 1, 2, 4, None]), r.choice(["grant", "revoke", "revoke", "praise", None]), r.choice([1, 2, 3, 4, 5, 6, 99, None])))
        else:
            looks.append((seq, r.choice([1, 2, 3, 4, 5, 6, None]), r.choice([*M.REVIEWS, "other", None]), r.randrange(9), r.choice([True, False, None]), " note ", T0 + datetime.timedelta(hours=seq)))
    owners, mods = {1}, {2}
    book = {(k, i): [s, a, b] for k, i, s, a, b, _ in entries}
    owner = {(k, i): o for k, i, _, _, _, o in entries}
    role, log = {}, []
    for x in sorted(asks + looks, key=lambda x: x[0]):
        if len(x) == 4:
            seq, actor, action, target = x
            if actor not in owners or target not in range(1, 7) or target in owners or action not in ("grant", "revoke") or (action == "revoke" and target not in mods):
                continue
            (mods.add if action == "grant" else mods.discard)(target)
            log.append((seq, action + "_moderator"))
            continue
        seq, actor, kind, i, yes, _, at = x
        if actor not in owners | mods or (kind, i) not in book or yes is None:
            continue
        e = book[kind, i]
        word, days, gives = M.REVIEWS[kind]
        e[0] = word if yes else "rejected"
        if yes or kind != "opportunity":
            e[1], e[2] = (at, at + datetime.timedelta(days)) if yes else (None, None)
        if yes and gives and owner[kind, i] is not None:
            role[owner[kind, i]] = gives
        log.append((seq, "approve" if yes else "reject"))
    a = spark.createDataFrame(admins, "user_id int, role string, active boolean")
    users = spark.createDataFrame([(i,) for i in range(1, 7)], "user_id int")
    es = spark.createDataFrame(entries, "kind string, id int, status string, since timestamp, until timestamp, owner int")
    g = M.grants(a, users, spark.createDataFrame(asks, "seq int, actor int, action string, target int")).cache()
    d = M.reviews(a, g, es, spark.createDataFrame(looks, "seq int, actor int, kind string, id int, approve boolean, notes string, at timestamp")).cache()
    assert sorted((x.seq, x.action) for x in M.audit(g, d).collect()) == log
    assert {x.notes for x in M.audit(g, d).where("target_type <> 'user'").collect()} == {"note"}
    assert {(x.kind, x.id): [x.status, x.since, x.until] for x in M.reviewed(es, d).collect()} == book
    assert {x.user_id: x.account_role for x in M.roles(es, d).collect()} == role
    assert {x.user_id for x in M.moderators(a, g).where("active AND role = 'moderator'").collect()} == mods
    assert {"not_owner", "no_user", "is_owner", "no_moderator", "no_action"} <= {x.refused for x in g.collect()}
    assert {"not_admin", "no_kind", "no_entry", "no_verdict"} <= {x.refused for x in d.collect()}


def test_workers(spark):
    at = lambda h: T0 + datetime.timedelta(hours=h)
    state = spark.createDataFrame([("a", 1, at(0), None), ("b", 2, at(0), None), ("c", None, at(0), at(0))], "worker string, job int, seen timestamp, stopped timestamp")
    rows = [("b", 1, at(1), "beat", 3), ("b", 2, at(2), "stop", None), ("c", 3, at(3), "beat", 4), ("d", 4, at(4), "stop", None), ("e", 5, at(5), "stop", None), ("e", 6, at(6), "beat", 7), ("f", 7, at(7), "beat", 8), ("f", 8, at(8), "stop", None), (None, 9, at(9), "beat", 1)]
    got = sorted(tuple(x) for x in M.workers(state, spark.createDataFrame(rows, "worker string, seq int, at timestamp, kind string, job int")).collect())
    assert got == [("a", 1, at(0), None), ("b", None, at(2), at(2)), ("c", 4, at(3), None), ("e", 7, at(6), None), ("f", None, at(8), at(8))]

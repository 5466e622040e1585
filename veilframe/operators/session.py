"""The session: states, and the fold of a log of actions into them. An action that does not fit the state changes nothing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("idle", "opening", "reviewing", "redacting", "complete", "failed", "lost")
LIVE = ("reviewing", "complete")
START = {"state": "idle", "job": None, "matches": {}, "ticked": set(), "downloaded": False, "failure": None, "terms": {}, "tier": "free"}


def seeded(matches: dict[str, dict]) -> set[str]:
    """Ids that start ticked: by default ticked and not blocked."""
    return {i for i, m in matches.items() if m.get("ticked") and not m.get("blocked")}


def _open(s: dict, p: dict, earlier: dict) -> dict:
    waiting = "searching" if p.get("tier", s["tier"]) == "paid" else "not-searched"
    terms = {t: earlier[t] if earlier.get(t) == "set-aside" else waiting for t in p.get("terms", [])}
    return {**START, "state": "opening", "job": p.get("job", s["job"]), "tier": p.get("tier", s["tier"]), "matches": {}, "ticked": set(), "terms": terms}


def _review(s: dict) -> dict:
    """Back from a finished run: what was made no longer stands."""
    return {**s, "state": "reviewing", "downloaded": False} if s["state"] == "complete" else s


def apply(s: dict, action: str, p: dict) -> dict:
    """The state after an action with its payload."""
    state = s["state"]
    if action == "file-chosen":
        return _open(s, p, {})
    if action == "progress":
        return s
    if action == "released":
        return dict(START)
    if action == "opened" and state == "opening":
        found = {m["id"]: m for m in p.get("matches", []) if m.get("term") is None or m["term"] in s["terms"]}
        return {**s, "state": "reviewing", "matches": found, "ticked": seeded(found), "terms": {t: "searched" if x == "searching" else x for t, x in s["terms"].items()}}
    if action in ("tick-toggled", "ticks-set") and state in LIVE:
        free = {i for i, m in s["matches"].items() if not m.get("blocked")}
        if action == "tick-toggled":
            ids = {p.get("id")} & free
            ticked = s["ticked"] ^ ids
        else:
            ids = set(p.get("ids", [])) & free
            ticked = s["ticked"] | ids if p.get("on") else s["ticked"] - ids
        return {**s, "state": "reviewing", "ticked": ticked, "downloaded": False} if ticked != s["ticked"] else s
    if (action == "redact-started" and state == "reviewing") or (action == "rerun" and state == "complete" and s["downloaded"]):
        searching = "searching" in s["terms"].values() or "not-searched" in s["terms"].values()
        return s if searching else {**s, "state": "redacting", "failure": None, "downloaded": False}
    if action == "redacted" and state == "redacting":
        return {**s, "state": "complete", "downloaded": False}
    if action == "downloaded" and state == "complete":
        return {**s, "downloaded": True}
    if action == "cancelled" and state == "redacting":
        return {**s, "state": "reviewing"}
    if action == "failed" and state in ("redacting", "opening"):
        return {**s, "state": "reviewing" if state == "redacting" else "failed", "failure": p.get("failure")}
    if action == "worker-lost" and state not in ("idle", "failed", "lost"):
        return {**s, "state": "lost", "failure": "engine-unavailable"}
    if action == "retry" and state == "lost":
        return _open(s, p, s["terms"])
    if action.startswith("terms-") and state in LIVE and p.get("job", s["job"]) == s["job"]:
        return _terms(s, action, p)
    return s


def _terms(s: dict, action: str, p: dict) -> dict:
    ids, terms = p.get("terms", []), dict(s["terms"])
    landing = [t for t in ids if terms.get(t) == "searching"]
    if action == "terms-searching" and s["tier"] == "paid" and ids:
        return {**_review(s), "terms": terms | dict.fromkeys(ids, "searching")}
    if action == "terms-found" and landing:
        rows = {m["id"]: m for m in p.get("matches", []) if m.get("term") in landing}
        return {**_review(s), "terms": terms | dict.fromkeys(landing, "searched"), "matches": s["matches"] | rows, "ticked": s["ticked"] | seeded(rows)}
    if action == "terms-failed" and landing:
        return {**s, "terms": terms | dict.fromkeys(landing, "not-searched")}
    if action == "terms-set-aside" and any(terms.get(t) == "not-searched" for t in ids):
        return {**s, "terms": {t: "set-aside" if t in ids and x == "not-searched" else x for t, x in terms.items()}}
    if action == "terms-removed" and any(t in terms for t in ids):
        found = {i: m for i, m in s["matches"].items() if m.get("term") not in ids or m.get("term") is None}
        return {**_review(s), "terms": {t: x for t, x in terms.items() if t not in ids}, "matches": found, "ticked": s["ticked"] & set(found)}
    return s


def fold(log: DataFrame) -> DataFrame:
    """(job_id, state, n_actions, n_changes, ticked) of a log (job_id, seq, action, payload json), each job in order. A job's log is bounded by its reader."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, changes = dict(START), 0
        for r in pdf.sort_values("seq").itertuples():
            then = apply(s, r.action, json.loads(r.payload or "{}"))
            changes += then is not s
            s = then
        return pd.DataFrame([(pdf.job_id.iloc[0], s["state"], len(pdf), changes, sorted(s["ticked"]))], columns=["job_id", "state", "n_actions", "n_changes", "ticked"])

    return log.groupBy("job_id").applyInPandas(run, "job_id string, state string, n_actions long, n_changes long, ticked array<string>")


def transitions(log: DataFrame) -> DataFrame:
    """(job_id, seq, action, before, after, failure, tier): what each action did to the state."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = dict(START), []
        for r in pdf.sort_values("seq").itertuples():
            then = apply(s, r.action, json.loads(r.payload or "{}"))
            out.append((r.job_id, r.seq, r.action, s["state"], then["state"], then["failure"] if then is not s else None, then["tier"]))
            s = then
        return pd.DataFrame(out, columns=["job_id", "seq", "action", "before", "after", "failure", "tier"])

    return log.groupBy("job_id").applyInPandas(run, "job_id string, seq long, action string, before string, after string, failure string, tier string")


# Refusals that mean a limit of the free tier was met, and which.
CAP_OF = {"too-many-pages": "pages", "too-large": "size"}


def usage_events(steps: DataFrame) -> DataFrame:
    """(job_id, seq, name, cap): events that transitions stand for: opened, completed, refused (a free reader's met limit is a cap instead), and an engine that is gone."""
    lost = (F.col("after") == "lost") & (F.col("before") != "lost")
    failed = F.col("before").isin("opening", "redacting") & (F.col("action") == "failed") & F.col("failure").isNotNull()
    cap = F.when(failed & (F.col("tier") == "free"), F.create_map(*[F.lit(x) for p in CAP_OF.items() for x in p])[F.col("failure")])
    gone = lost | (failed & (F.col("failure") == "engine-unavailable"))
    names = F.array_compact(F.array(
        F.when((F.col("before") == "opening") & (F.col("after") == "reviewing"), "document-opened"), F.when((F.col("before") == "redacting") & (F.col("after") == "complete"), "redaction-completed"),
        F.when(cap.isNotNull(), "cap-reached").when(lost | failed, "run-refused"), F.when(gone, "engine-unavailable"),
    ))
    told = steps.withColumn("cap", cap).withColumn("name", F.explode(names))
    return told.select("job_id", "seq", "name", F.when(F.col("name") == "cap-reached", F.col("cap")).alias("cap"))

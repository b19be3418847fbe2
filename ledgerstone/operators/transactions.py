"""Transactions: command checks, id resolution, retention, replay of the commands and of the status machine."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses by number, days after which finished, failed and unused things go.
UNKNOWN, OPEN, WAITING, CHECKING, INGEST, FINISHED, ERROR = range(7)
FINISHED_DAYS, ERROR_DAYS, UPLOAD_DAYS = 4, 7, 14
#: Each verb's number of words.
ARITY = {"delete": 2, "slot": 3, "note": 2, "add": 2, "mimetype": 3, "sleep": 1}


def well_formed(command: Column) -> Column:
    """Known verb, right number of words, and a number to delete."""
    verb = F.get(command, F.lit(0))
    counts = F.create_map(*[F.lit(x) for pair in ARITY.items() for x in pair])
    number = F.get(command, F.lit(1)).rlike("^[+-]?[0-9]+$")
    right = F.coalesce(F.element_at(counts, verb) == F.size(command), F.lit(False))
    return right & ((verb != "delete") | F.coalesce(number, F.lit(False)))


def referenced_files(transactions: DataFrame) -> DataFrame:
    """(tx, file) of the add commands."""
    adds = F.filter("commands", lambda c: (F.get(c, F.lit(0)) == "add") & (F.size(c) == 2))
    return transactions.select("tx", F.explode(F.transform(adds, lambda c: F.get(c, F.lit(1)))).alias("file"))


def verify_files(transactions: DataFrame, uploads: DataFrame) -> DataFrame:
    """(tx, file, problem) for added files that are missing or whose content isn't what was stated (uploads: file, verified)."""
    rows = referenced_files(transactions).join(uploads.select("file", "verified"), "file", "left")
    problem = F.when(F.col("verified").isNull(), "missing").when(~F.col("verified"), "checksum")
    return rows.select("tx", "file", problem.alias("problem")).where("problem is not null")


def resolve_ids(slots: DataFrame, blob_map: DataFrame) -> DataFrame:
    """Slot commands (tx, name, target): the target is a file of blob_map (tx, file, blobid), else a number, else an error."""
    m = blob_map.select("tx", F.col("file").alias("target"), F.col("blobid").alias("_m"))
    number = F.when(F.col("target").rlike("^[+-]?[0-9]+$"), F.col("target").try_cast("int"))
    rows = slots.join(m, ["tx", "target"], "left").select("tx", "name", "target", F.coalesce("_m", number).alias("blobid"))
    return rows.withColumn("failed", F.col("blobid").isNull())


def in_process(transactions: DataFrame) -> DataFrame:
    """Transactions that keep their item from another."""
    return transactions.where(~F.col("status").isin(FINISHED, ERROR))


def admitted(transactions: DataFrame) -> DataFrame:
    """Transactions for the work queue."""
    return transactions.where(~F.col("status").isin(OPEN, FINISHED, ERROR))


def creatable(requests: DataFrame, transactions: DataFrame) -> DataFrame:
    """Requests (item, ...) whose item has no transaction in process."""
    return requests.join(in_process(transactions).select("item").distinct(), "item", "left_anti")


def cancellable(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.col("status").isin(FINISHED, ERROR))


def cancel(transactions: DataFrame, ids: list[str]) -> DataFrame:
    """Without the given transactions, if they have ended."""
    return transactions.where(~(F.col("tx").isin(*ids) & F.col("status").isin(FINISHED, ERROR)))


def expired_transactions(transactions: DataFrame, now: datetime) -> DataFrame:
    age = lambda days: F.col("modified") <= F.lit(now) - F.expr(f"interval {days} days")
    return transactions.where(((F.col("status") == FINISHED) & age(FINISHED_DAYS)) | ((F.col("status") == ERROR) & age(ERROR_DAYS)))


def expired_uploads(uploads: DataFrame, now: datetime) -> DataFrame:
    return uploads.where(F.col("modified") <= F.lit(now) - F.expr(f"interval {UPLOAD_DAYS} days"))


def append_commands(transactions: DataFrame, batches: DataFrame, now: datetime) -> DataFrame:
    """batches (tx, new: array of commands) are appended only if every command is well-formed; the modified time moves then."""
    b = batches.where(F.forall("new", well_formed))
    hit = F.col("new").isNotNull()
    out = transactions.join(b.select("tx", "new"), "tx", "left").withColumn("commands", F.when(hit, F.concat("commands", "new")).otherwise(F.col("commands")))
    return out.withColumn("modified", F.when(hit, F.lit(now).cast(dict(transactions.dtypes)["modified"])).otherwise(F.col("modified"))).drop("new")


def set_status(transactions: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Transactions with the status of changes (tx, status; one row of a transaction); the modified time moves."""
    c = changes.select("tx", F.col("status").alias("_status"))
    hit = F.col("_status").isNotNull()
    out = transactions.join(c, "tx", "left").withColumn("modified", F.when(hit, F.lit(now).cast(dict(transactions.dtypes)["modified"])).otherwise(F.col("modified")))
    return out.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def append_errors(transactions: DataFrame, errors: DataFrame) -> DataFrame:
    """errors (tx, position, error) go behind a transaction's ``errors`` in order; nothing is saved, so the modified time stays."""
    rows = errors.groupBy("tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "error"))), lambda x: x["error"]).alias("_new"))
    out = transactions.join(rows, "tx", "left")
    return out.withColumn("errors", F.concat("errors", F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def replay(commands: DataFrame, known: DataFrame) -> DataFrame:
    """Fold of commands (tx, position, words) in order; known: (tx, file) that exist.

    One row for each transaction: applied commands, the error it stopped at
    (empty if none), status, deletions, slots set, the last note. A
    transaction's rows stream by; only its slot names are held.
    """
    rows = commands.join(known.select("tx", "file", F.lit(True).alias("_there")), (commands["tx"] == known["tx"]) & (F.get("words", F.lit(0)) == "add") & (F.get("words", F.lit(1)) == known["file"]), "left")
    rows = rows.select(commands["tx"], "position", "words", well_formed(F.col("words")).alias("good"), F.coalesce("_there", F.lit(False)).alias("there"))
    rows = rows.repartition("tx").sortWithinPartitions("tx", "position")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tx, state = None, None
        names = ["tx", "applied", "status", "error", "n_deleted", "n_slots", "note"]

        def row():
            return (tx, state["applied"], ERROR if state["error"] else FINISHED, state["error"], len(state["gone"]), len(state["slots"]), state["note"])

        for pdf in batches:
            out = []
            for t, words, good, there in zip(pdf["tx"], pdf["words"], pdf["good"], pdf["there"], strict=True):
                if state is None or t != tx:
                    if state is not None:
                        out.append(row())
                    tx, state = t, {"applied": 0, "error": "", "gone": set(), "slots": {}, "files": set(), "note": ""}
                if state["error"]:
                    continue
                verb = words[0] if len(words) else ""
                if not good:
                    state["error"] = f"malformed {verb}"
                elif verb == "add" and not there:
                    state["error"] = f"missing {words[1]}"
                elif verb == "slot" and words[2] not in state["files"] and not words[2].lstrip("+-").isdigit():
                    state["error"] = f"unknown {words[2]}"
                else:
                    state["applied"] += 1
                    if verb == "add":
                        state["files"].add(words[1])
                    elif verb == "delete":
                        state["gone"].add(int(words[1]))
                    elif verb == "slot":
                        state["slots"][words[1]] = words[2]
                    elif verb == "note":
                        state["note"] = words[1]
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([row()], columns=names)

    kind = dict(commands.dtypes)["tx"]
    return rows.mapInPandas(fold, f"tx {kind}, applied int, status int, error string, n_deleted int, n_slots int, note string")


def advance(status: int, event: str) -> int:
    """The status machine: commit, check_ok, check_failed, ingest_ok, ingest_failed; other events change nothing."""
    moves = {(OPEN, "commit"): WAITING, (WAITING, "start"): CHECKING, (CHECKING, "check_ok"): INGEST, (CHECKING, "check_failed"): ERROR, (INGEST, "ingest_ok"): FINISHED, (INGEST, "ingest_failed"): ERROR}
    return moves.get((status, event), status)


def replay_status(events: DataFrame) -> DataFrame:
    """The status of each transaction after its events (tx, position, event), from open."""
    names = ("commit", "start", "check_ok", "check_failed", "ingest_ok", "ingest_failed")
    table = F.array(*[F.array(*[F.lit(advance(s, e)) for e in names]) for s in range(7)])
    code = F.array_position(F.array(*[F.lit(e) for e in names]), F.col("event"))
    ordered = events.groupBy("tx").agg(F.array_sort(F.collect_list(F.struct("position", code.alias("code")))).alias("e"))
    step = lambda s, e: F.when(e["code"] > 0, F.get(F.get(table, s), (e["code"] - 1).cast("int"))).otherwise(s)
    return ordered.select("tx", F.aggregate("e", F.lit(OPEN), step).alias("status"))

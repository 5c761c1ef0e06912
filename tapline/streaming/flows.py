"""Flow assembly across micro-batches: per flow id only counters are kept, never packets, and not for ever."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.packet_flows import (
    FLAG_MASKS, MARKER_MISMATCH, NO_END, NO_ID, NO_PACKETS, OTHER_ENDPOINTS, OTHER_PROTOCOL, SQUARE_BITS, TCP,
    finished_flows, packet_errors, reason_text,
)
from .frames import plain_text

SALTS = 64
_SIDES = ("fwd_packets", "fwd_bytes", "bwd_packets", "bwd_bytes")
_FLAGS = tuple(f"{n}_count" for n in FLAG_MASKS)
_HEAD = ("src", "dst", "src_port", "dst_port", "proto")
_STATE = (
    "segment long, open boolean, dead boolean, src string, dst string, src_port long, dst_port long, proto long, at long, t0 long, t1 long, "
    + ", ".join(f"{n} long" for n in (*_SIDES, "squares_high", "squares_low", *_FLAGS))
    + ", reasons array<string>"
)
_NAMES = [part.split()[0] for part in _STATE.split(", ")]
_OUT = (
    "uid string, segment long, head_src string, head_dst string, head_src_port long, head_dst_port long, head_proto long, "
    "head_at long, first_us long, last_us long, end_us long, end_seq long, "
    + ", ".join(f"{n} long" for n in (*_SIDES, "squares_high", "squares_low", *_FLAGS))
    + ", flow_end_observed boolean, incomplete_reasons array<string>, emitted_at timestamp"
)
_COLUMNS = [part.split()[0] for part in _OUT.split(", ")]


def _int(value):
    return None if pd.isna(value) else int(value)


def _text(value):
    return None if pd.isna(value) else value


class FlowProcessor(StatefulProcessor):
    """Counters of the open flow of a flow id, and how many it has had.

    Rows come in arrival order over the micro-batches. A timer ``quiet_ms`` of event time after the last packet
    ends an open flow without its marker and forgets the id.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle):
        self.handle = handle
        self.flow = handle.getValueState("flow", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            yield self._frame([self._nameless(r, timerValues.getCurrentWatermarkInMs()) for part in rows for r in part.to_dict("records")])
            return
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", ignore_index=True)
        state = dict(zip(_NAMES, self.flow.get())) if self.flow.exists() else self._new(0)
        clock = timerValues.getCurrentWatermarkInMs()
        is_end = (batch["flow_complete"] == True).to_numpy()  # noqa: E712 - nulls are not ends
        out = []
        for _, part in batch.groupby(is_end.cumsum() - is_end, sort=True):
            closing = part[is_end[part.index]]
            state = self._add(state, part[~is_end[part.index]])
            if len(closing):
                out.append(self._finish(key[0], state, closing.iloc[0], clock))
                state = self._new(state["segment"] + 1)
        times = batch["t"].dropna()
        last = max([clock, *([int(times.max()) // 1000] if len(times) else [])])
        self.flow.update(tuple(state[n] for n in _NAMES))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.quiet_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = dict(zip(_NAMES, self.flow.get()))
        self.flow.clear()
        yield self._frame([self._finish(key[0], state, None, timerValues.getCurrentWatermarkInMs())] if state["open"] else [])

    def _frame(self, rows):
        out = pd.DataFrame(rows, columns=_COLUMNS)
        whole = [p.split()[0] for p in _OUT.split(", ") if p.endswith(" long")]
        return plain_text(out).astype({c: "Int64" for c in whole} | {"emitted_at": "datetime64[us]"})

    def _new(self, segment):
        return dict.fromkeys(_NAMES) | dict.fromkeys((*_SIDES, "squares_high", "squares_low", *_FLAGS), 0) | {"segment": segment, "open": False, "dead": False, "reasons": []}

    def _nameless(self, packet, clock):
        """A packet without a flow id is an incomplete flow of its own and leaves no state."""
        at = _int(packet["t"])
        done = self._new(0) | {"uid": None, "head_at": at, "flow_end_observed": False, "incomplete_reasons": [NO_ID]}
        done |= {f"head_{c}": (_text if c in ("src", "dst") else _int)(packet[c]) for c in _HEAD if c != "proto"}
        done["emitted_at"] = pd.Timestamp(max((clock + 1) * 1000, at or 0), unit="us")
        return [done.get(c) for c in _COLUMNS]

    def _add(self, state, packets):
        if not len(packets):
            return state
        if not state["open"]:
            head = packets.iloc[0]
            dead = pd.notna(head["head_error"])
            first = {c: (_text if c in ("src", "dst") else _int)(head[c]) for c in _HEAD}
            state = state | first | {"open": True, "dead": bool(dead), "at": _int(head["t"]), "reasons": [head["head_error"]] if dead else []}
        if state["dead"]:
            broken = packets[packets["flow_complete"].isna()]["error"].dropna()
            return state | {"reasons": list(dict.fromkeys([*state["reasons"], *broken]))}
        same = (packets["src"] == state["src"]) & (packets["dst"] == state["dst"])
        same &= (packets["src_port"] == state["src_port"]) & (packets["dst_port"] == state["dst_port"])
        back = (packets["src"] == state["dst"]) & (packets["dst"] == state["src"])
        back &= (packets["src_port"] == state["dst_port"]) & (packets["dst_port"] == state["src_port"])
        why = packets["error"].astype(object)
        why[why.isna() & (packets["proto"] != state["proto"])] = OTHER_PROTOCOL
        why[why.isna() & ~(same | back)] = OTHER_ENDPOINTS
        good = packets[why.isna()]
        forward, payload = same[good.index], good["payload_len"].astype("int64")
        tcp = good["proto"] == TCP
        flagged = good["flags_error"][tcp & good["flags_error"].notna()]
        why[flagged.index] = flagged
        flags = good["tcp_flags"].fillna(0).astype("int64").where(tcp, 0)
        squares = payload * payload
        moved = {
            "fwd_packets": int(forward.sum()), "bwd_packets": int((~forward).sum()),
            "fwd_bytes": int(payload[forward].sum()), "bwd_bytes": int(payload[~forward].sum()),
            "squares_high": int((squares // (1 << SQUARE_BITS)).sum()), "squares_low": int((squares % (1 << SQUARE_BITS)).sum()),
            **{f"{n}_count": int(((flags & m) != 0).sum()) for n, m in FLAG_MASKS.items()},
        }
        state = state | {k: state[k] + v for k, v in moved.items()} | {"reasons": list(dict.fromkeys([*state["reasons"], *why.dropna()]))}
        times = good["t"].dropna()
        for name, least in (("t0", min), ("t1", max)) if len(times) else ():
            at = int(times.min() if name == "t0" else times.max())
            state[name] = at if state[name] is None else least(state[name], at)
        return state

    def _finish(self, uid, state, marker, clock):
        reasons, ended = list(state["reasons"]), marker is not None
        if not state["open"]:
            reasons = [NO_PACKETS]
        elif not state["dead"]:
            if not ended:
                reasons.append(NO_END)
            else:
                wrong = [c for c in _HEAD if pd.notna(marker[c]) and marker[c] != state[c]]
                reasons += [MARKER_MISMATCH.format(c) for c in wrong]
        end = _int(marker["t"]) if ended else None
        at = max(t for t in (end, state["t1"], state["at"], (clock + 1) * 1000) if t is not None)
        done = {
            "uid": uid, "segment": state["segment"], **{f"head_{c}": state[c] for c in _HEAD}, "head_at": state["at"],
            "first_us": state["t0"], "last_us": state["t1"], "end_us": end, "end_seq": int(marker["seq"]) if ended else None,
            **{c: state[c] for c in (*_SIDES, "squares_high", "squares_low", *_FLAGS)},
            "flow_end_observed": ended, "incomplete_reasons": list(dict.fromkeys(reasons)), "emitted_at": pd.Timestamp(at, unit="us"),
        }
        return [done[c] for c in _COLUMNS]

    def close(self):
        pass


def packets_to_flows_stream(
    df: DataFrame, seq: str = "arrival_seq", quiet_seconds: float = 300.0, late_seconds: float = 5.0, nameless: bool = True
) -> DataFrame:
    """Flows of a packet stream, with the columns and features of ``packets_to_flows``, each at its end marker.

    Packets arrive in order of micro-batch, then of ``seq``; the first sets the direction. Event time is ``ts``, with a
    watermark ``late_seconds`` behind; packets behind it are dropped. A flow silent for ``quiet_seconds`` of event time comes out as
    incomplete and its id is forgotten, so state is bounded by what was active in that span. ``emitted_at``
    is the event-time column for operators that follow. With ``nameless`` every packet without a flow id
    comes out too, as an incomplete flow of its own. Needs the RocksDB state store.
    """
    if quiet_seconds <= 0:
        raise ValueError("state needs an end: quiet_seconds must be positive")
    errors = packet_errors(df)
    text = lambda code: reason_text(code, F.col("proto"))
    timed = df.select("*", F.col("ts").cast("timestamp").alias("event_time")).withWatermark("event_time", f"{late_seconds} seconds")
    # Rows without an id stay in the one stream, spread by a salt: a branch of their own would hold the watermark back.
    prepared = timed.select(
        "uid", F.when(F.col("uid").isNull(), F.pmod(F.xxhash64(seq), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"),
        "event_time", F.col(seq).cast("long").alias("seq"), F.unix_micros("event_time").alias("t"),
        "src", "src_port", "dst", "dst_port", "proto", "payload_len", "tcp_flags", "flow_complete",
        text(F.coalesce(errors["marker"], errors["field"], errors["payload"])).alias("error"),
        text(F.coalesce(errors["marker"], errors["head"])).alias("head_error"),
        text(errors["flags"]).alias("flags_error"),
    )
    sums = prepared.groupBy("uid", "salt").transformWithStateInPandas(
        statefulProcessor=FlowProcessor(int(quiet_seconds * 1000)), outputStructType=_OUT, outputMode="append",
        timeMode="EventTime", eventTimeColumnName="emitted_at",
    )
    time = lambda c: F.timestamp_micros(F.col(c))
    counters = sums.select(
        "*", time("head_at").alias("head__at"), time("first_us").alias("_start"), time("last_us").alias("_stop"), time("end_us").alias("_end_ts"),
        F.col("end_seq").alias("_end_seq"), F.col("squares_high").alias("_squares_high"), F.col("squares_low").alias("_squares_low"),
    )
    flows = finished_flows(counters, keep=("emitted_at",))
    return flows if nameless else flows.filter(F.col("flow_id").isNotNull())

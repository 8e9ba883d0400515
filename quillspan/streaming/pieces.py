"""Sources that arrive in pieces: lines and their findings by state kept for each source (T-B).

A piece is a row of source_id, piece_no (from 0 on, without gaps), text and last (true in the last piece of a source). Texts
of a source's pieces, joined by number, are its text; a cut may lie anywhere, also within CR LF. What a line rule must know of
earlier lines is state: the place reached, the unfinished line, the length of the run of equal lines, the line before, and a
map from long lines' fingerprints to where each stood first. Only the unfinished line is held in memory; the map and pieces
that come too early stay in the state store, so a source of any length runs in bounded memory.

* Pieces may come in any order and any batches; one that comes early waits until those before it are there.
* A piece whose number was read already is a repeat and is left out, whatever it says; so is what follows the last piece.
* A null text counts as empty, a null ``last`` as false; rows without source or number are left out.
* An unfinished line is told when its end or the last piece comes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspan.operators.anomaly import AnomalyPolicy, line_findings
from quillspan.operators.lines import LINE

PIECE = "source_id string, piece_no long, text string, last boolean"
#: A physical line with what the lines before it say: ``run`` as ``anomaly.line_runs`` has it, the first place of an equal
#: long line, and the line before where both are long enough to compare scripts.
LINE_STATE = "source_id string, line_no long, start_char long, end_char long, physical string, content string, run long, first_line long, first_start long, first_end long, content_before string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a source's reader holds in memory before it goes to the state: characters of early pieces, fingerprints.
HELD_CHARACTERS, NEW_PRINTS = 4 << 20, 50_000

_LINE = re.compile(LINE)
_ENDS = re.compile("[\r\n]")
#: White space as Java's (?U)\s has it, which Python's \s exceeds by four separators.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Reader:
    """A source's place while its pieces are read: what the state says at the start of a batch, and is told at its end."""

    def __init__(self, kept: tuple | None, tail: list[str]):
        self.piece, self.line, self.char, self.run, self.print, self.before, self.done = kept or (0, 0, 0, 0, b"", None, False)
        self.tail = tail

    def kept(self) -> tuple:
        return self.piece, self.line, self.char, self.run, self.print, self.before, self.done

    def lines(self, text: str, last: bool) -> list[str]:
        """Lines that the next piece finishes. A CR at its end may be half of CR LF, so it waits as well."""
        self.piece, self.done = self.piece + 1, last
        open_cr = bool(self.tail) and self.tail[-1].endswith("\r")
        if not (last or open_cr or _ENDS.search(text)):
            self.tail += [text] if text else []
            return []
        found = _LINE.findall("".join([*self.tail, text]))
        self.tail = [] if last or not found or found[-1].endswith("\n") else [found.pop()]
        return found


class LineKeeper(StatefulProcessor):
    """Rows of LINE_STATE from pieces of one source, in order of its lines."""

    def __init__(self, policy: AnomalyPolicy):
        self.least_copy, self.least_script = policy.duplicate_min_characters, policy.script_shift_min_characters

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "piece long, line long, char long, run long, print binary, before string, done boolean")
        self.tail = handle.getListState("tail", "part string")
        self.early = handle.getMapState("early", "piece_no long", "text string, last boolean")
        self.first = handle.getMapState("first", "print binary", "line_no long, start_char long, end_char long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.place.get() if self.place.exists() else None
        now = _Reader(kept, [part for (part,) in self.tail.get()] if kept else [])
        if now.done:
            return
        self.new_prints, self.prints_stored = {}, bool(kept)
        self.held, self.held_size, self.early_stored = {}, 0, bool(kept) and self.early.exists()
        for frame in rows:
            for piece, text, last in zip(frame["piece_no"].tolist(), frame["text"].tolist(), frame["last"].tolist(), strict=True):
                told = (text if isinstance(text, str) else "", last is True)
                if piece > now.piece:
                    self._hold(int(piece), told)
                elif piece == now.piece:
                    while told and not now.done:
                        out = self._rows(key[0], now, now.lines(*told))
                        if len(out):
                            yield out
                        told = self._take(now.piece)
                if now.done:
                    break
            if now.done:
                break
        if now.done:
            for state in (self.tail, self.early, self.first) if kept or self.early_stored or self.prints_stored else ():
                state.clear()
            now.before, now.print = None, b""
        else:
            self._store_held()
            self._store_prints()
            if now.tail:
                self.tail.put([(part,) for part in now.tail])
            elif kept:
                self.tail.clear()
        self.place.update(now.kept())

    def _hold(self, piece: int, told: tuple[str, bool]) -> None:
        """An early piece waits in memory, up to HELD_CHARACTERS, and then in the state; the first of equal numbers counts."""
        if piece not in self.held and not (self.early_stored and self.early.containsKey((piece,))):
            self.held[piece] = told
            self.held_size += len(told[0]) + 100
            if self.held_size > HELD_CHARACTERS:
                self._store_held()

    def _take(self, piece: int) -> tuple[str, bool] | None:
        told = self.held.pop(piece, None)
        if told is not None:
            self.held_size -= len(told[0]) + 100
        elif self.early_stored:
            told = self.early.getValue((piece,))
            if told is not None:
                self.early.removeKey((piece,))
        return told

    def _store_held(self) -> None:
        for piece, told in self.held.items():
            self.early.updateValue((piece,), told)
        self.early_stored |= bool(self.held)
        self.held, self.held_size = {}, 0

    def _store_prints(self) -> None:
        for mark, where in self.new_prints.items():
            self.first.updateValue((mark,), where)
        self.prints_stored |= bool(self.new_prints)
        self.new_prints = {}

    def _first(self, mark: bytes, here: tuple[int, int, int]) -> tuple:
        """Where a long line stood first, if before; else it is noted. Up to NEW_PRINTS notes wait in memory: where a source
        ends in the batch it began in, none is ever stored."""
        where = self.new_prints.get(mark) or (self.first.getValue((mark,)) if self.prints_stored else None)
        if where is None:
            self.new_prints[mark] = here
            if len(self.new_prints) >= NEW_PRINTS:
                self._store_prints()
        return where or (None, None, None)

    def _rows(self, source: str, now: _Reader, lines: list[str]) -> pd.DataFrame:
        out = []
        for physical in lines:
            content = physical.rstrip("\r\n")
            normal = _SPACE.sub(" ", content).strip(" ")
            mark = blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            now.line += 1
            now.run = now.run + 1 if mark == now.print else 1
            end = now.char + len(content)
            first = (None, None, None)
            if len(normal) >= self.least_copy:
                first = self._first(mark, (now.line, now.char, end))
            long_ = len(content) >= self.least_script
            out.append((source, now.line, now.char, end, physical, content, now.run if normal else 0, *first, now.before if long_ else None))
            now.char, now.print, now.before = now.char + len(physical), mark, content if long_ else None
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in LINE_STATE.split(", ")])
        return frame.astype({c: "Int64" for c in ("first_line", "first_start", "first_end")})

    def close(self) -> None:
        pass


def lines_of_pieces(pieces: DataFrame, policy: AnomalyPolicy = AnomalyPolicy()) -> DataFrame:
    """The stream of LINE_STATE rows of a stream of pieces; state is kept by source_id."""
    told = pieces.select("source_id", "piece_no", "text", "last").where("source_id is not null and piece_no is not null")
    return told.groupBy("source_id").transformWithStateInPandas(LineKeeper(policy), outputStructType=LINE_STATE, outputMode="Append", timeMode="None")


@contextmanager
def _kept_in_rocks(spark: SparkSession):
    """A query begun inside keeps its state in RocksDB, which state by keys asks for; the session's own setting comes back."""
    own = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, own)


def watch_pieces(spark: SparkSession, folder: str, out: str, checkpoint: str, policy: AnomalyPolicy = AnomalyPolicy(), once: bool = True, files: int = 1000) -> StreamingQuery:
    """Lines and findings of the line rules over pieces (Parquet of PIECE) that newly appear in ``folder``, at ``out``/lines and
    ``out``/findings. A batch of ``files`` files overwrites its own partition of both, so one that is repeated after a failure
    leaves no second copy; state goes on from ``checkpoint``."""

    def write(batch: DataFrame, number: int) -> None:
        lines = f"{out}/lines/batch={number}"
        batch.write.mode("overwrite").parquet(lines)  # the state moves once; the rules read what was written
        found = line_findings(spark.read.schema(LINE_STATE).parquet(lines), policy)
        found.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")

    pieces = spark.readStream.schema(PIECE).option("maxFilesPerTrigger", files).parquet(folder)
    with _kept_in_rocks(spark):
        stream = lines_of_pieces(pieces, policy).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (stream.trigger(availableNow=True) if once else stream).start()


def cut_in_pieces(sources: DataFrame, width: int) -> DataFrame:
    """Texts of ``sources`` (source_id, text) as pieces of ``width`` characters; an empty or null text is one empty piece."""
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{width}}}"), 0)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    each = sources.select("source_id", F.size(parts).alias("n"), F.posexplode(parts).alias("at", "text"))
    return each.select("source_id", F.col("at").cast("long").alias("piece_no"), "text", (F.col("at") == F.col("n") - 1).alias("last"))

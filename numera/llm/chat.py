"""Chat formatting, assembled from tokens.

Role and text of each turn are encoded on their own, by a byte-level tokenizer that
gives back every string, and laid out as

    TURN role TEXT text END

TURN, TEXT and END are ids behind the vocabulary's, spliced in between: no text can
produce them. The loss mask is a prefix sum over +1 where a learnt text begins and -1
where it ends; a turn's place in its conversation is a prefix sum over token counts.

Written out as text, the ids are control strings. Those strings, and the control
strings of other templates, are escaped where they occur in a content, so that text
that is tokenized again later has no false turns either: a backslash goes in behind
the first character, also where backslashes stand there already. Taking one out gives
back the content exactly, since no control string has its first character, or a
backslash, a second time.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What the reserved ids read as, in the order of the ids.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Control strings that contents get escaped: the own ones and those of other templates.
CONTROLS = (*MARKS, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]")
#: Roles whose texts are learnt.
LEARNT = ("assistant",)
#: Characters of contents that are encoded at a time.
_AT_ONCE = 1 << 20
#: Turn numbers of a block, within which token counts are summed up apart.
_BLOCK_BITS = 8

assert all(c[0] not in c[1:] and "\\" not in c for c in CONTROLS)
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_FIRSTS = "".join(sorted({re.escape(c[0]) for c in CONTROLS}))
#: A control string, with any number of backslashes behind its first character.
CONTROL_PATTERN = rf"([{_FIRSTS}])(\\*)({_RESTS})"


def escaped(text: Column) -> Column:
    """``text`` with one more backslash in each control string."""
    return F.regexp_replace(text, CONTROL_PATTERN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, CONTROL_PATTERN.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


class Template:
    """A byte-level tokenizer with reserved ids behind its vocabulary."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the vocabulary's own special tokens are ordinary text in a content
        self.tokenizer.encode_special_tokens = True
        self.turn, self.text, self.end = range(size := self.tokenizer.get_vocab_size(with_added_tokens=True), size + 3)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each content; an error where they do not give the content back."""
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.decode(ids) != texts:
            raise ValueError("the tokenizer does not give back every text")
        return ids

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def assemble(self, roles: list[np.ndarray], texts: list[np.ndarray], learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all turns one behind the other, their loss mask, and where turns begin, with the end."""
        role, text = (np.array([len(x) for x in own], np.int64) for own in (roles, texts))
        begins = np.concatenate(([0], np.cumsum(role + text + 3)))
        at = begins[:-1] + role + 2  # of the texts
        ids = np.empty(begins[-1], np.int32)
        inside = np.ones(len(ids), bool)
        for places, mark in ((begins[:-1], self.turn), (at - 1, self.text), (begins[1:] - 1, self.end)):
            ids[places], inside[places] = mark, False
        ids[inside] = np.concatenate([x for pair in zip(roles, texts) for x in pair] or [np.zeros(0, np.int32)])
        steps = np.zeros(len(ids) + 1, np.int8)
        steps[at[learnt]] += 1
        # an empty text begins and ends at one place
        steps[(at + text)[learnt]] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8), begins

    def parse(self, ids: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, list[str], list[str], list[str]]:
        """Where turns begin in assembled ids, their roles, texts, and what of the texts is under the mask."""
        turn, text, end = (np.flatnonzero(ids == mark) for mark in (self.turn, self.text, self.end))
        if not (len(turn) == len(text) == len(end) and (turn < text).all() and (text < end).all() and (end[:-1] < turn[1:]).all()):
            raise ValueError("marks of turns are out of order")
        spans = [(ids[a + 1 : b], ids[b + 1 : c], loss[a : c + 1], loss[b + 1 : c]) for a, b, c in zip(turn, text, end)]
        if any(whole.sum() != own.sum() for _, _, whole, own in spans):
            raise ValueError("the mask covers more than texts")
        return turn, self.decode([s[0] for s in spans]), self.decode([s[1] for s in spans]), self.decode([s[1][s[3] > 0] for s in spans])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _lists(flat: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat, kind))


def _assembled(path: str, learnt: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        template = None
        for batch in batches:
            template = template or Template(path)
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            sizes, at = np.cumsum([len(r) + len(t) for r, t in zip(roles, texts)]), 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _AT_ONCE, "right")))
                n = to - at
                encoded = template.encode(roles[at:to] + texts[at:to])
                ids, loss, begins = template.assemble(encoded[:n], encoded[n:], np.array([r in learnt for r in roles[at:to]], bool))
                own = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [own.column("conv_id"), own.column("turn"), pa.array(np.diff(begins)), _lists(ids, begins, pa.int32()), _lists(loss, begins, pa.int8())],
                    ["conv_id", "turn", "n_tokens", "ids", "loss"],
                )
                at = to

    return run


def format_turns(conversations: DataFrame, path: str | None = None, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """(conv_id, turn, start, n_tokens, ids, loss): a row for each row of ``conversations`` (conv_id, turn, role, text).

    ``ids`` of a conversation's rows, by ``start``, the number of tokens before,
    are the conversation; ``loss`` is 1 for tokens to learn, the texts of the
    ``learnt`` roles without the marks. ``path`` names a byte-level tokenizer
    that every executor can open.

    Null roles and texts count as empty, a null conv_id is a conversation of
    its own, a null turn comes first. Rows of one turn follow one another by
    their ids; rows that repeat are all kept. Texts are encoded whole; other
    columns are not looked at; an empty table gives an empty result.
    """
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    names = [r for r in learnt if not re.search(CONTROL_PATTERN, r)]
    if len(names) < len(learnt):
        raise ValueError("a learnt role has a control string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), escaped(own[0]).alias("role"), escaped(own[1]).alias("text"))
    turns = rows.mapInArrow(_assembled(path or default_path(), tuple(learnt)), "conv_id long, turn long, n_tokens long, ids array<int>, loss array<tinyint>")
    # Counts are summed up by blocks of turns, so that no task has all rows of a long conversation.
    # A struct is equal to another where both hold null, so a null id joins like any other.
    key = ["__conv", "__block"]
    turns = turns.select("*", F.struct("conv_id").alias("__conv"), F.coalesce(F.call_function("shiftright", F.col("turn"), F.lit(_BLOCK_BITS)), F.lit(-(2**63))).alias("__block"))
    before = Window.partitionBy(*key).orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    local = turns.withColumn("__local", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    totals = turns.groupBy(*key).agg(F.sum("n_tokens").alias("__n"))
    blocks = Window.partitionBy("__conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, F.coalesce(F.sum("__n").over(blocks), F.lit(0)).alias("__before"))
    return local.join(offsets, key).select("conv_id", "turn", (F.col("__local") + F.col("__before")).alias("start"), "n_tokens", "ids", "loss")


def _parsed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        template = None
        marks = sum(map(len, MARKS))
        for batch in batches:
            if not batch.num_rows:
                continue
            template = template or Template(path)
            ids, loss = batch.column("ids"), batch.column("loss")
            bounds = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            at, roles, texts, learnt = template.parse(ids.flatten().to_numpy(), loss.flatten().to_numpy())
            row = np.searchsorted(bounds, at, "right") - 1
            start = batch.column("start").to_numpy()[row] + at - bounds[row]
            chars = [len(r) + len(t) + marks for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(pa.array(row)), pa.array(start), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(learnt, pa.string()), pa.array(chars, pa.int64())],
                ["conv_id", "start", "role", "text", "loss_text", "formatted_chars"],
            )

    return run


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, start, role, text, loss_text, formatted_chars) of each turn, from rows (conv_id, start, ids, loss) of one turn or several.

    Read from the ids and the mask alone; contents come back unescaped.
    ``loss_text`` is what the mask covers, ``formatted_chars`` counts the code
    points of the turn written out with its marks and escapes. Ids whose marks
    are out of order are an error.
    """
    rows = formatted.select("conv_id", "start", "ids", "loss").mapInArrow(_parsed(path or default_path()), "conv_id long, start long, role string, text string, loss_text string, formatted_chars long")
    return rows.select("conv_id", "start", *(unescaped(F.col(c)).alias(c) for c in ("role", "text", "loss_text")), "formatted_chars")


def written_out(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, start, formatted): each turn as text, control strings for the marks, contents escaped."""
    rows = formatted.select("conv_id", "start", "ids", "loss").mapInArrow(_parsed(path or default_path()), "conv_id long, start long, role string, text string, loss_text string, formatted_chars long")
    turn, text, end = map(F.lit, MARKS)
    return rows.select("conv_id", "start", F.concat(turn, "role", text, "text", end).alias("formatted"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a sorted stream; of an unfinished one only the state of the hashes is kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    own, done = None, []

    def close() -> None:
        done.append((own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]))

    for batch in batches:
        for conv, turn, loss, loss_chars, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_bytes", "loss_bytes", "loss_chars", "formatted_chars"))):
            if own is None or own[0] != conv:
                if own is not None:
                    close()
                own = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            own[1] += 1
            own[2].update(turn)
            own[3] += loss_chars
            own[4].update(loss)
            own[5] += chars
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)] if done else [pa.array([], k) for k in kinds], names)
        done = []
    if own is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the rows of ``read_back``.

    A digest of a whole conversation is made in order, hence in one task, which
    streams the sorted rows and holds none of them.
    """
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    rows = turns.select("conv_id", "start", line.cast("binary").alias("turn_bytes"), F.col("loss_text").cast("binary").alias("loss_bytes"), F.length("loss_text").cast("long").alias("loss_chars"), "formatted_chars")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that consists of control strings, which the query formats beside the table's.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def oracle_sql() -> str:
    def sql(column: str) -> str:
        return f"regexp_replace(coalesce({column}, ''), '{CONTROL_PATTERN}', '\\1\\\\\\2\\3', 'g')"

    values = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)
    marks = sum(map(len, MARKS))
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES {values}) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({sql('role')}) + length({sql('text')}) + {marks})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

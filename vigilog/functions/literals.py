"""Which of many literals a text holds, found in one pass over it."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # each literal is then searched by itself
    ahocorasick = None

WORD = 62  # literals per word of the result


@lru_cache(maxsize=8)
def _automaton(literals: tuple):
    machine = ahocorasick.Automaton()
    for i, literal in enumerate(literals):
        machine.add_word(literal, (i // WORD, 1 << i % WORD))
    machine.make_automaton()
    return machine


def held(text: Column, literals: tuple) -> Column:
    """struct<w0, w1, ...>: bit i % WORD of word i / WORD says whether the text holds literal i.

    An Aho-Corasick automaton reads the text once, however many literals there are. Spark's own functions
    would read it once for each. Texts go over in Arrow batches, and only they do.
    """
    words = -(-len(literals) // WORD)

    @F.arrow_udf(f"struct<{','.join(f'w{i}:bigint' for i in range(words))}>")
    def find(texts):
        import numpy as np
        import pyarrow as pa

        machine = _automaton(literals)
        out = np.zeros((words, len(texts)), dtype=np.int64)
        for row, value in enumerate(texts.to_pylist()):
            if value:
                found = [0] * words
                for _, (word, bit) in machine.iter(value):
                    found[word] |= bit
                for word, bits in enumerate(found):
                    if bits:
                        out[word, row] = bits
        return pa.StructArray.from_arrays([pa.array(column) for column in out], names=[f"w{i}" for i in range(words)])

    return find(text)


def holds_any(column: str, numbers: dict, clause: tuple) -> str:
    """SQL: the text whose ``held`` is in a column holds any of the clause's literals, given their numbers."""
    masks: dict[int, int] = {}
    for literal in clause:
        i = numbers[literal]
        masks[i // WORD] = masks.get(i // WORD, 0) | 1 << i % WORD
    return "(" + " OR ".join(f"({column}.w{word} & {mask}L) != 0" for word, mask in sorted(masks.items())) + ")"

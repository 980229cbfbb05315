"""Sizes of texts in tokens of a public tokenizer, given by the path of its file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Sequence

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public split pattern of the byte-level BPE vocabularies of 50,257 ids.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _load(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        own = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(x)) for x in texts]
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in own.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one worker a core is busy already
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def counter(path: str = DEFAULT) -> Callable[[Sequence[str | None]], list[int]]:
    """A function giving the tokens of each whole text; null and empty texts have none.

    ``path`` names a ``.tiktoken`` file of ranks, a ``sentencepiece`` ``.model`` or a ``tokenizers`` JSON file, which must lie
    there on every executor. To be made once a task: it loads the file.
    """
    count = _load(path)

    def sizes(texts: Sequence[str | None]) -> list[int]:
        at = [i for i, t in enumerate(texts) if t]
        out = [0] * len(texts)
        for i, n in zip(at, count([texts[i] for i in at]) if at else [], strict=True):
            out[i] = n
        return out

    return sizes

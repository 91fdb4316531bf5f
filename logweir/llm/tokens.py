"""Ids of public vocabularies, made where Spark runs the tasks.

The vocabularies lie beside the Python package that names them; a name is a
parameter, nothing is trained or copied.
"""

from __future__ import annotations

import base64
import re

#: Characters whose classes every version of Unicode in use agrees on; texts of other ones take the slower library.
_SETTLED = re.compile("[\u0000-\u02af\u0384-\u0481\u1e00-\u1eff\u2010-\u205e\u20a0-\u20ac\u2190-\u21ff\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


class ByteTokens:
    """A byte-level vocabulary: ``<name>.json`` and, with the same ids, ``<name>.tiktoken``.

    Both libraries give the same ids; the second is several times faster.  The
    first one decides for texts with characters that their tables of Unicode
    classes may hold differently.
    """

    def __init__(self, name: str):
        import public_tokenizers as vocabularies
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabularies.path(f"{name}.json"))
        self.plain = Tokenizer.from_file(vocabularies.path(f"{name}.json"))
        self.plain.encode_special_tokens = True
        with open(vocabularies.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        special = {
            token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items() if token.special
        }
        self.fast = tiktoken.Encoding(name, pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        #: Bytes of each id.
        self.bytes = [token for token, _ in sorted(ranks.items(), key=lambda item: item[1])]

    def with_specials(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens are those tokens."""
        if _SETTLED.fullmatch(text) and not any(mark in text for mark in self.special):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens are text like any other."""
        if _SETTLED.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.plain.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A sentence-piece vocabulary ``<name>.model``."""

    def __init__(self, name: str):
        import public_tokenizers as vocabularies
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path(f"{name}.model"))
        self.bytes = []
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(number) else piece.replace("▁", " ").encode())

    def ordinary(self, text: str) -> list[int]:
        return self.model.encode(text)

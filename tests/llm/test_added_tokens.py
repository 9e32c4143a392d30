"""Added tokens in texts, against the tokenizers library."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def test_added_tokens_equal_the_library():
    texts = ["plain text", END, "", f"a  {END}  b", f"{END}{END}", f"x{END}", f"<|endof{END}text|>", "<|endof", "text|> of two", f"don't{END}'s 12{END}34 é{END}日", "last"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    ids, cut = bpe.Bpe.of_merges(PATH).encode(data, off)
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t

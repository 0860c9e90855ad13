"""Parameter surface (S6) and its validation.

All values end up as literals in Column expressions; nothing here touches data.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

# Fixed values that must equal the reference's defaults for the same results.
# hash_key 15485863; gamma 0.25; delta 2.0; z threshold 4.0; seeding "simple_1";
# generation seed 123; temperature 0.7; 500 new tokens; 500 documents.
DEFAULT_HASH_KEY = 15485863
DEFAULT_VOCAB_SIZE = 32003  # prime, see greenscan.functions.greenlist
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
# Settings files: a key that is named differently here, and keys that concern the model or UI.
KEY_NAMES = {"detection_z_threshold": "z_threshold"}
OTHER_KEYS = frozenset({"run_gradio", "demo_public", "model_name_or_path", "load_fp16", "use_gpu",
                        "skip_model_load"})
SEEDING_SCHEMES = ("simple_1",)
NORMALIZER_NAMES = ("unicode", "unicode:whitespaces", "unicode:ascii", "unicode:idn",
                    "homoglyphs", "truecase")


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    if n % 2 == 0:
        return n == 2
    f = 3
    while f * f <= n:
        if n % f == 0:
            return False
        f += 2
    return True


def next_prime(n: int) -> int:
    while not is_prime(n):
        n += 1
    return n


# The words accepted for a flag, as the reference accepts them.
FLAG_WORDS = {word: truth for truth, words in ((True, ("yes", "true", "t", "y", "1")),
                                               (False, ("no", "false", "f", "n", "0")))
              for word in words}


def str2bool(v) -> bool:
    """A user's flag as a truth value (P17); words outside ``FLAG_WORDS`` are refused."""
    word = str(v).strip().lower()
    if word not in FLAG_WORDS:
        raise ValueError(f"not a flag: {v!r} (use one of {', '.join(FLAG_WORDS)})")
    return FLAG_WORDS[word]


def parse_normalizers(spec) -> tuple[str, ...]:
    """Comma list -> tuple (S7); empty -> (); unknown names fail here (Q10)."""
    if spec is None or spec == "":
        return ()
    names = tuple(s.strip() for s in spec.split(",")) if isinstance(spec, str) else tuple(spec)
    from greenscan.functions.normalize import _CUSTOM
    for n in names:
        if n not in NORMALIZER_NAMES and n not in _CUSTOM:
            raise ValueError(f"unknown normalizer: {n!r}")
    return names


@dataclass(frozen=True)
class WatermarkConfig:
    vocab_size: int = DEFAULT_VOCAB_SIZE
    gamma: float = 0.25
    delta: float = 2.0
    seeding_scheme: str = "simple_1"
    hash_key: int = DEFAULT_HASH_KEY
    select_green_tokens: bool = True
    z_threshold: float = 4.0
    normalizers: tuple = field(default_factory=tuple)
    ignore_repeated_bigrams: bool = False
    token_pattern: str = TOKEN_PATTERN
    lowercase: bool = True
    bos_id: int | None = None
    # generation / evaluation
    max_new_tokens: int = 500
    generation_seed: int = 123
    use_sampling: bool = True
    n_beams: int = 1
    sampling_temp: float = 0.7
    seed_separately: bool = True
    prompt_max_length: int | None = None
    limit_dataset: int | None = None
    dataset_name_or_path: str = "documents"
    dataset_section: str | None = None
    csv_path: str | None = None

    def __post_init__(self):
        if self.seeding_scheme not in SEEDING_SCHEMES:
            raise NotImplementedError(f"no such seeding scheme here: {self.seeding_scheme}")
        if not is_prime(self.vocab_size):
            raise ValueError(f"vocab_size must be prime, got {self.vocab_size}; "
                             f"use next_prime({self.vocab_size}) = {next_prime(self.vocab_size)}")
        if not 0.0 < self.gamma < 1.0:
            raise ValueError("gamma must be in (0, 1)")
        if self.vocab_size ** 2 >= 2 ** 62:
            raise ValueError("vocab_size too large for 64-bit bigram codes")
        object.__setattr__(self, "normalizers", parse_normalizers(self.normalizers))

    @property
    def n_green(self) -> int:
        """Greenlist size: int(V * gamma), truncating as the reference does."""
        return int(self.vocab_size * self.gamma)

    def replace(self, **kw) -> "WatermarkConfig":
        return dataclasses.replace(self, **kw)

    @classmethod
    def from_yaml(cls, path: str) -> "WatermarkConfig":
        """Parameters from a YAML file with the reference's keys (S6); model and UI
        keys are ignored, the comma list of normalisers is parsed (S7)."""
        import yaml
        with open(path, encoding="utf-8") as f:
            return cls.from_mapping(yaml.safe_load(f) or {})

    @classmethod
    def from_mapping(cls, m: dict) -> "WatermarkConfig":
        """Parameters of a YAML-like mapping. Keys for the model and the UI are left out;
        any other unknown key is an error, so no setting is dropped unseen."""
        fields = {f.name: f for f in dataclasses.fields(cls)}
        given = {KEY_NAMES.get(k, k): v for k, v in m.items() if k not in OTHER_KEYS}
        if unknown := sorted(set(given) - set(fields)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        for k, v in given.items():
            if fields[k].type == "bool" and not isinstance(v, bool):
                given[k] = str2bool(v)
            elif fields[k].type == "float" and v is not None:
                given[k] = float(v)
        return cls(**given)

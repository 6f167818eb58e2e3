"""Schemas of the tables, and settings: defaults, YAML and environment overlays, presets."""

from __future__ import annotations

import copy
import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession

CHUNKS = "recording_id string, sequence int, start_time timestamp, source_path string, proxy_path string, duration_seconds double, global_start_seconds double"
SAMPLES = "recording_id string, sequence int, sample_rate int, block_idx long, block array<float>"
TRACE = "recording_id string, sequence int, strategy string, frame_idx long, t double, value double, threshold double"
PEAK = "struct<time_seconds: double, score: double>"
EVENTS_JSON = f"start_seconds double, end_seconds double, duration_seconds double, peaks array<{PEAK}>"
SHEET = "clip_file string, start_seconds double, end_seconds double, duration_seconds double, max_peak_score double, verdict string, notes string, guess string, guess_basis string"
GOLDEN = "time_seconds double, sources array<string>"
VERDICT = "struct<is_event: boolean, confidence: double, frame_index: int, rationale: string, caption: string>"
VERDICT_CACHE = f"idx long, start_seconds double, end_seconds double, verdict {VERDICT}"
SENT = "clip_file string, message_id long, sent_at string"

ENV_PREFIX = "TIDEMARK__"


# The names and numbers below are those that settings files are written with.
@dataclass
class Input:
    source_dir: str = ""
    use_lrf_for_detection: bool = True


@dataclass
class Audio:
    sample_rate: int = 22050
    mono: bool = True


@dataclass
class RmsEnergy:
    window_seconds: float = 0.5
    hop_seconds: float = 0.1
    baseline_window_seconds: float = 60.0
    threshold_sigma: float = 3.0
    min_absolute_dbfs: float = -40.0
    min_score_dbfs: float = 3.5


@dataclass
class OnsetFlux:
    window_seconds: float = 0.05
    hop_seconds: float = 0.01
    baseline_window_seconds: float = 30.0
    threshold_sigma: float = 2.5
    min_score: float = 0.55


@dataclass
class Combined:
    window_before_seconds: float = 2.0
    window_after_seconds: float = 12.0


@dataclass
class Detection:
    strategy: str = "onset_flux"
    rms_energy: RmsEnergy = field(default_factory=RmsEnergy)
    onset_flux: OnsetFlux = field(default_factory=OnsetFlux)
    combined: Combined = field(default_factory=Combined)


@dataclass
class Timeline:
    lookback_seconds: float = 6.0
    post_peak_seconds: float = 5.0
    min_gap_seconds: float = 5.0
    min_interval_seconds: float = 5.0
    warmup_seconds: float = 10.0


@dataclass
class Output:
    mode: str = "clips"
    dir: str = "output"
    force_reencode_on_concat: bool = False


@dataclass
class Metadata:
    events_path: str = "output/events.json"
    debug_plot_path: str = "output/debug_audio.png"


@dataclass
class Encoding:
    max_width: int = 1280
    fps: float = 30.0
    crf: int = 23
    preset: str = "veryfast"
    threads: int = 4
    audio_bitrate_kbps: int = 128
    mono_audio: bool = False


@dataclass
class Review(Encoding):
    output_root: str = "output/review"
    max_negative_clip_seconds: float = 120.0
    min_negative_clip_seconds: float = 8.0


@dataclass
class Export(Encoding):
    dir: str = "output/export"
    max_width: int = 2560
    crf: int = 18
    preset: str = "medium"
    threads: int = 0
    audio_bitrate_kbps: int = 192


@dataclass
class Caller:
    """What a model or a chat is called with; calls themselves are outside the engine."""

    enabled: bool = False
    model: str = ""
    api_key_env: str = ""
    peak_window_seconds: float = 4.0
    drop_confidence_threshold: float = 0.75
    add_confidence_threshold: float = 0.75
    request_timeout_seconds: float = 60.0
    max_retries: int = 2


@dataclass
class Vision(Caller):
    frames_per_window: int = 5
    frame_max_width: int = 640
    highlights_dir: str = "output/vision_highlights"
    scan_chunk_max_seconds: float = 120.0
    scan_chunk_min_seconds: float = 8.0


@dataclass
class Video(Caller):
    clip_max_width: int = 640


@dataclass
class LabelAudit:
    review_root: str = "output/review"
    output_dir: str = "output/label_audit"
    flag_distance_threshold: float = 0.5


@dataclass
class Posting:
    bot_token_env: str = ""
    chat_id_env: str = ""
    max_file_size_mb: float = 50.0
    request_timeout_seconds: float = 120.0
    max_retries: int = 2


@dataclass
class Settings:
    input: Input = field(default_factory=Input)
    audio: Audio = field(default_factory=Audio)
    detection: Detection = field(default_factory=Detection)
    timeline: Timeline = field(default_factory=Timeline)
    output: Output = field(default_factory=Output)
    metadata: Metadata = field(default_factory=Metadata)
    review: Review = field(default_factory=Review)
    export: Export = field(default_factory=Export)
    vision: Vision = field(default_factory=Vision)
    gemini: Video = field(default_factory=Video)
    label_audit: LabelAudit = field(default_factory=LabelAudit)
    telegram: Posting = field(default_factory=Posting)


#: The presets, as overlays of the defaults.
PRESETS = {
    "crowd_loose": {"detection": {"strategy": "rms_energy", "rms_energy": {"threshold_sigma": 3.0, "min_score_dbfs": 1.5}}},
    "crowd_strict": {"detection": {"strategy": "rms_energy", "rms_energy": {"threshold_sigma": 3.0, "min_score_dbfs": 3.5}}},
    "strike_loose": {"detection": {"strategy": "onset_flux", "onset_flux": {"threshold_sigma": 2.5, "min_score": 0.55}}},
    "strike_strict": {"detection": {"strategy": "onset_flux", "onset_flux": {"threshold_sigma": 2.0, "min_score": 0.60}}},
    "combo_loose": {"detection": {"strategy": "combined", "onset_flux": {"threshold_sigma": 2.0, "min_score": 0.30}, "rms_energy": {"threshold_sigma": 3.0, "min_score_dbfs": 3.0}, "combined": {"window_before_seconds": 2.0, "window_after_seconds": 20.0}}},
    "combo_strict": {"detection": {"strategy": "combined", "onset_flux": {"threshold_sigma": 2.0, "min_score": 0.40}, "rms_energy": {"threshold_sigma": 3.0, "min_score_dbfs": 3.0}, "combined": {"window_before_seconds": 2.0, "window_after_seconds": 10.0}}},
}
#: Fixed value: seconds within which labels of one event meet.
GOLDEN_CLUSTER_SECONDS = 12.0
SWEEP_THRESHOLDS = (1.01, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50)


def entries(settings, before: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """The dotted paths of all single settings."""
    for f in fields(settings):
        own = getattr(settings, f.name)
        yield from entries(own, (*before, f.name)) if is_dataclass(own) else [(*before, f.name)]


def leaves(values: Mapping, before: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Paths and values of nested mappings; a section without content is None."""
    for name, value in values.items():
        path, value = (*before, str(name)), None if value == {} else value
        if isinstance(value, Mapping):
            yield from leaves(value, path)
        else:
            yield path, value


def put(settings, path: tuple[str, ...], value, source: str) -> None:
    """Set one entry; text becomes what the entry holds. A path that isn't one is a ValueError that names its source."""
    if path not in set(entries(settings)):
        sections = {p[:n] for p in entries(settings) for n in range(1, len(p))}
        if value is None and path in sections:
            return  # a section left empty
        raise ValueError(f"{source}: there is no setting {'.'.join(path)}")
    for name in path[:-1]:
        settings = getattr(settings, name)
    kind = type(getattr(settings, path[-1]))
    if isinstance(value, str) and kind is not str:
        value = value.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
    setattr(settings, path[-1], value)


def overlay(settings: Settings, values: Mapping | None, source: str = "settings") -> Settings:
    for path, value in leaves(values or {}):
        put(settings, path, value, source)
    return settings


def from_environment(settings: Settings, environment: Mapping[str, str] | None = None) -> Settings:
    """PREFIX__SECTION__...__NAME, of any depth."""
    for name, text in sorted((os.environ if environment is None else environment).items()):
        if name.startswith(ENV_PREFIX):
            put(settings, tuple(name[len(ENV_PREFIX) :].lower().split("__")), text, name)
    return settings


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_settings(path: str | None = None, environment: Mapping[str, str] | None = None, flags: Mapping | None = None) -> Settings:
    """Flags over environment over YAML over defaults."""
    settings = overlay(Settings(), _yaml(path) if path else None, path or "")
    return overlay(from_environment(settings, environment), flags, "flags")


def load_presets(base: Settings, path: str) -> dict[str, Settings]:
    """The named overlays of a file's ``strategies``, each over a copy of the base."""
    return {name: overlay(copy.deepcopy(base), values, f"{path}: {name}") for name, values in (_yaml(path).get("strategies") or {}).items()}


def preset(base: Settings, name: str) -> Settings:
    return overlay(copy.deepcopy(base), PRESETS[name], name)


def preset_table(spark: SparkSession, base: Settings | None = None) -> DataFrame:
    """A row for each preset: what crosses the signals of all recordings."""
    rows = []
    for name in PRESETS:
        s = preset(base or Settings(), name)
        d = s.detection
        rows.append((name, d.strategy, d.onset_flux.threshold_sigma, d.onset_flux.min_score, d.rms_energy.threshold_sigma, d.rms_energy.min_score_dbfs, d.rms_energy.min_absolute_dbfs, d.combined.window_before_seconds, d.combined.window_after_seconds))
    return spark.createDataFrame(rows, "preset string, strategy string, flux_sigma double, flux_score double, rms_sigma double, rms_score double, rms_floor double, before double, after double")

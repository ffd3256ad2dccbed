"""Descriptive labels of an experiment derived from its configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Config = Callable[[str], Column]

# The label tables.
PHASE_PREFIXES = {
    "A": "BASELINES",
    "P": "Transfuser",
    "F": "Latent Transfuser",
    "L": "LAW",
    "exp_b": "PHASE_1",
    "exp_c": "PHASE_2",
}
ARCHITECTURES = {
    "transfuser_agent": "TransFuser",
    "diffusiondrive_ijepa_agent": "DiffusionDrive",
    "ego_status_mlp_agent": "EgoStatusMLP",
}
ARCHITECTURE_PARTS = {"constant_velocity": "ConstantVelocity", "law_agent": "LawAgent"}
BACKBONE_TYPES = {"transfuser_agent": "RNN", "diffusiondrive_ijepa_agent": "Diffusion", "law_agent": "RNN"}
BACKBONES = {
    "resnet": "ResNet34",
    "ijepa": "I-JEPA ViT-H/14",
    "dinov2": "DINOv2 ViT-S/14",
    "dino": "DINO ViT-B/16",
    "mae": "MAE ViT-L/16",
}
SSL_METHODS = {"ijepa": "I-JEPA", "dinov2": "DINOv2", "dino": "DINO", "mae": "MAE"}
VIT_SIZES = {
    "vit_tiny": "ViT-Ti",
    "vit_small": "ViT-S",
    "vit_base": "ViT-B",
    "vit_large": "ViT-L",
    "vit_huge": "ViT-H",
    "vit_giant": "ViT-G",
}
VISION_AGENTS = ["transfuser_agent", "diffusiondrive_ijepa_agent"]
TRAINABLE_KEYS = {
    "ijepa": "pc_trainable_ijepa_layers",
    "dinov2": "pc_trainable_dinov2_layers",
    "dino": "pc_trainable_dino_layers",
    "mae": "pc_trainable_mae_layers",
}
CHECKPOINT_KEYS = ["ijepa_checkpoint_path", "dinov2_checkpoint_path", "mae_checkpoint_path"]


def lookup(key: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    hits = [F.when(key == F.lit(k), F.lit(v)) for k, v in table.items()]
    return F.coalesce(*hits, *([default] if default is not None else []))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def phase(exp_id: Column, given: Column) -> Column:
    """An explicit phase other than UNKNOWN, else by id prefix, in table order."""
    known = F.nullif(_filled(given), F.lit("UNKNOWN"))
    by_prefix = [F.when(F.startswith(exp_id, F.lit(p)), F.lit(label)) for p, label in PHASE_PREFIXES.items()]
    # An explicit empty phase stays empty when no prefix applies.
    return F.coalesce(known, *by_prefix, F.when(given == "", F.lit("")), F.lit("UNKNOWN"))


def architecture(config: Config) -> Column:
    agent = F.coalesce(config("agent"), F.lit(""))
    parts = [F.when(F.contains(agent, F.lit(k)), F.lit(v)) for k, v in ARCHITECTURE_PARTS.items()]
    return F.coalesce(_filled(config("architecture")), lookup(agent, ARCHITECTURES), *parts, F.lit("Unknown"))


def backbone(config: Config) -> Column:
    """Display name of the backbone; a raw method key such as 'mae' is resolved, not shown."""
    agent = F.coalesce(config("agent"), F.lit(""))
    raw = config("backbone")
    shown = F.coalesce(
        config("backbone_name"),
        F.when(~_filled(raw).isin([*SSL_METHODS, "resnet"]), _filled(raw)))
    method = F.coalesce(raw, F.lit("resnet"))
    size = _filled(config("vit_arch"))
    patch = config("vit_patch_size").try_cast("bigint")
    custom = F.coalesce(config("vit_backend"), F.lit("huggingface")) == "custom"
    sized = F.concat(
        lookup(method, SSL_METHODS), F.lit(" "), lookup(size, VIT_SIZES, size),
        F.when(patch != 0, F.concat(F.lit("/"), patch.cast("string"))).otherwise(""),
        F.when(custom, " (nuScenes)").otherwise(""))
    plain = F.concat(
        lookup(method, BACKBONES, method),
        F.when((method != "resnet") & custom, " (custom)").otherwise(""))
    inferred = (
        F.when(agent.isin(VISION_AGENTS), F.coalesce(sized, plain))
        .when(agent == "law_agent", F.lit("ResNet34"))
        .otherwise(""))
    return F.coalesce(shown, inferred)


def backbone_type(config: Config) -> Column:
    return F.coalesce(config("backbone_type"), lookup(config("agent"), BACKBONE_TYPES), F.lit(""))


def freeze_percent(config: Config) -> Column:
    """Given percentage, or 100 less the trainable share of the backbone, to one decimal."""
    given = F.coalesce(config("freeze_percent").try_cast("double"), F.lit(0.0))
    method = F.coalesce(config("backbone"), F.lit("resnet"))
    trainable = F.coalesce(*[F.when(method == k, config(key).try_cast("double")) for k, key in TRAINABLE_KEYS.items()])
    derived = F.when(config("agent").isin(VISION_AGENTS), F.round((1 - trainable) * 100, 1))
    return F.when(given == 0, F.coalesce(derived, given)).otherwise(given)


def effective_batch(config: Config) -> Column:
    def number(key: str, default: int) -> Column:
        return F.coalesce(config(key).try_cast("bigint"), F.lit(default).cast("bigint"))

    return number("num_gpus", 1) * number("batch_size", 32) * number("accumulate_grad_batches", 1)


def resolution(config: Config) -> Column:
    """struct(resolution_type, input_resolution); both NULL for the convolutional backbone."""
    conv = F.coalesce(config("backbone"), F.lit("resnet")) == "resnet"
    native = F.coalesce(config("use_native_resolution").try_cast("boolean"), F.lit(True))
    return F.struct(
        F.when(~conv, F.when(native, "rect").otherwise("square")).alias("resolution_type"),
        F.when(~conv, F.when(native, "native (snapped to patch)").otherwise("224x224")).alias("input_resolution"))


def weight_source(config: Config) -> Column:
    """Where the weights come from, by the first checkpoint path that tells."""

    def from_path(path: Column) -> Column:
        own = F.contains(F.lower(path), F.lit("nuscenes")) | F.contains(path, F.lit("_r/")) | F.contains(path, F.lit("_s/"))
        public = F.contains(path, F.lit("IN1K")) | F.contains(F.lower(path), F.lit("imagenet"))
        return F.when(own, "nuScenes").when(public, "ImageNet")

    conv = F.coalesce(config("backbone"), F.lit("resnet")) == "resnet"
    return F.when(conv, "ImageNet (supervised)").otherwise(
        F.coalesce(*[from_path(config(key)) for key in CHECKPOINT_KEYS], F.lit("ImageNet")))


def cell_status(has_dir: Column, has_checkpoint: Column, has_log: Column) -> Column:
    return (F.when(has_dir & has_checkpoint, "DONE").when(has_dir & has_log, "RUNNING")
            .when(has_dir, "EMPTY").otherwise("—"))

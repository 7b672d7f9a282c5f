"""Run configuration: ``Tag value #comment`` lines."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RunConfig:
    output_path: str = ""
    num_tasks_io_in_parallel: int = -1
    simulation_type: str = ""
    snapshot_file_list: str = ""
    bbox_output_file: str = ""
    halo_file: str = ""
    halo_file_format: str = ""
    halo_chunk_size_mb: int = 0
    domain_buff_size: float = -1.0
    n_rnn: int = -1
    n_div: int = -1

    def __post_init__(self):
        need = {
            "OutputPath": self.output_path,
            "BBoxOutputFile": self.bbox_output_file,
            "NumTasksIOInParallel": self.num_tasks_io_in_parallel > 0,
            "DomainBuffSize": self.domain_buff_size > 0,
            "NRnn": self.n_rnn > 0,
            "Ndiv": self.n_div > 0,
        }
        if self.halo_file:
            need["HaloChunkSizeMB"] = self.halo_chunk_size_mb > 0
            need["HaloFileFormat"] = self.halo_file_format
        missing = [tag for tag, ok in need.items() if not ok]
        if missing:
            raise ValueError(f"missing or invalid settings: {', '.join(missing)}")


_FIELDS = {f.name.replace("_", ""): f for f in fields(RunConfig)}
_TYPES = {"str": str, "int": int, "float": float}


def parse_config(text: str) -> RunConfig:
    """Tags in any case; blank lines and lines starting with # are skipped."""
    found = {}
    for line in text.replace("\t", " ").splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        tag, _, rest = line.partition(" ")
        value = rest.split("#", 1)[0].split()
        field = _FIELDS.get(tag.lower())
        if field is None:
            raise ValueError(f"tag {tag!r} not found")
        found[field.name] = _TYPES[field.type](value[0]) if value else field.default
    return RunConfig(**found)


def read_config(path: str) -> RunConfig:
    with open(path) as f:
        return parse_config(f.read())

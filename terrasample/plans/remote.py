"""Remote image services, which this engine replaces with mirrors."""


def init_remote(credentials_path: str | None = None) -> None:
    """Always fails: remote services need a network and credentials."""
    raise RuntimeError(
        "remote image services aren't available: register a source with register_source, or mirror the data as GeoTIFF files or tile tables"
    )

"""Sources: landed JSON envelopes and request manifests."""

from rollcall.operators.joins import lookup_keys  # noqa: F401  (keyed scan = semi join)
from rollcall.sources.envelope import (  # noqa: F401
    DAY_COL, FILE_COL, POS_COL, day_folders, envelope_schema, explode_envelope, explode_records, explode_root,
    json_field, read_envelope, read_records,
)
from rollcall.sources.keyed import bucket_of, keyed_scan, land_by_key  # noqa: F401
from rollcall.sources.landed import (  # noqa: F401
    completeness, fingerprints, landed_days, landed_files, page_number, paged_manifest,
)
from rollcall.sources.manifest import not_landed, request_manifest  # noqa: F401

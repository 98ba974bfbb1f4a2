"""Parameters of the registered plans on the TPC-H-derived fixture.

The reference's literals (a 2024 date cutoff, a ``%NY%`` address pattern, 500 units) select
nothing in the fixture's dates and names, so the registered plans use values that select a
real share of the data. The operators' defaults stay the reference's literals.
"""

from __future__ import annotations

FIXTURE: dict[str, dict] = {
    "recent_receipts": {"after": "2001-06-01"},
    "region_customer_receipts": {"address_pattern": "%NATION_1,%"},
    "high_volume_reg_data": {"min_received": 300},
    "high_volume_reg": {"min_received": 300},
    "high_volume_reg_coefficients": {"min_received": 300},
    "high_volume_reg_residuals": {"min_received": 300},
    "statistical_summary": {"min_received": 300},
    "statistical_summary_batches": {"min_received": 300, "cuts": ["1995-06-17"]},
}

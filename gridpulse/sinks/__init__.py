"""Writers: keyed tables, counters and published reports."""

"""Set-oriented operators over a memory's components."""

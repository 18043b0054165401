"""Training-data operators.

Everything here stands alone: the rest of the library never imports this
subpackage, and removing it leaves the other operators working.
"""

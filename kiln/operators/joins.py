"""Size bound of explicit broadcasts."""

# a side is broadcast only when its measured (or fixed-width) size is below
BROADCAST_MAX_BYTES = 64 << 20

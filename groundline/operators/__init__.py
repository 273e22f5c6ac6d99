"""DataFrame operators. Keys come first (``scene_id`` or any others); nothing loops over scenes."""

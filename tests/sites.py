"""Four test yards (projected metres, EPSG 32612) and the parameters of their synthetic scenes."""

from __future__ import annotations

from typing import NamedTuple


class Site(NamedTuple):
    name: str
    origin_x: float
    origin_y: float
    threshold: float
    seed: int
    ndvi_mean: float
    ndvi_spread: float
    cover_target: float
    intercept: float
    slope: float
    r2: float
    cloud: float
    ring: tuple[tuple[float, float], ...]


SITES = (
    Site("site_a", 392800, 3716600, 0.66, 20260805, 0.14, 0.09, 0.09, 46.2, -15.4, 0.72, 0.0, ((393774.696, 3715585.835), (393791.273, 3715604.547), (393792.881, 3715604.731), (393839.322, 3715564.321), (393851.599, 3715553.4), (393857.829, 3715553.296), (393856.442, 3715479.193), (393856.379, 3715475.803), (393855.691, 3715474.254), (393854.317, 3715473.214), (393772.216, 3715473.999))),
    Site("site_b", 396100, 3721300, 0.62, 20260806, 0.22, 0.11, 0.24, 44.1, -13.1, 0.63, 0.0, ((397174.597, 3720326.46), (397173.596, 3720231.009), (397082.164, 3720230.5), (397081.085, 3720234.649), (397083.121, 3720237.932), (397082.773, 3720240.095), (397082.625, 3720246.782), (397079.575, 3720249.307), (397070.179, 3720256.028), (397066.756, 3720258.472), (397068.572, 3720261.272), (397071.363, 3720265.693), (397073.815, 3720269.95), (397075.87, 3720274.207), (397077.393, 3720278.091), (397078.611, 3720281.801), (397080.311, 3720287.177), (397081.631, 3720293.757), (397082.126, 3720298.207), (397082.443, 3720304.561), (397082.678, 3720309.947), (397082.866, 3720319.552), (397082.922, 3720322.871), (397082.961, 3720324.924), (397085.883, 3720324.953), (397160.578, 3720325.717))),
    Site("site_c", 388000, 3703900, 0.6, 20260807, 0.33, 0.13, 0.55, 42.0, -11.8, 0.55, 0.0, ((389087.368, 3702834.662), (388992.267, 3702834.904), (388990.613, 3702835.077), (388989.423, 3702835.702), (388988.013, 3702837.14), (388987.407, 3702838.181), (388987.078, 3702839.532), (388988.395, 3702925.279), (389088.295, 3702924.166), (389088.058, 3702901.026))),
    Site("site_d", 382900, 3700500, 0.63, 20260808, 0.16, 0.1, 0.12, 45.5, -14.6, 0.68, 0.34, ((383930.488, 3699381.13), (383939.421, 3699373.204), (383940.703, 3699359.091), (383983.304, 3699363.392), (384002.612, 3699362.799), (384003.4, 3699362.855), (384004.26, 3699363.409), (384005.038, 3699364.471), (384005.27, 3699366.209), (384006.24, 3699395.663), (384008.374, 3699475.304), (384008.298, 3699476.345), (384007.972, 3699477.548), (384007.302, 3699478.349), (384006.155, 3699479.134), (384005.003, 3699479.54), (384003.507, 3699479.602), (383920.837, 3699470.771))),
)

"""canvass package."""

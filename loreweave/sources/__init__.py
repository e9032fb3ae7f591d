"""loreweave.sources"""
